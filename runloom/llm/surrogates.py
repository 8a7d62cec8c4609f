"""Personal data replaced by keyed surrogates of the same type, format, gender and script.

1. Every text is searched for entities; each mention has a canonical form (digits of a
   number, lower-cased address), so that its spellings are one entity.
2. Distinct entities draw a surrogate from a keyed hash. Draws that another entity
   holds, or that are themselves an entity of the corpus, are drawn again, until
   distinct entities have distinct surrogates. This is a table of entities, worked on by joins.
3. Each document gets the surrogates of its own entities and writes them into the
   mentions' own format: separators, letter case and lengths stay.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import flagged
from runloom.session import stage

# Titles that announce a person, by gender, and names to draw from by gender and script.
TITLES = {
    "m": ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"],
}
GIVEN = {
    ("m", "LATIN"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Nils", "Oscar", "Paul"],
    ("f", "LATIN"): ["Alice", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("m", "CYRILLIC"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим"],
    ("f", "CYRILLIC"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Лидия", "Мария", "Нина"],
}
SURNAME_PARTS = {
    "LATIN": ["al", "ber", "cor", "den", "er", "fal", "gar", "hol", "in", "jor", "kel", "lan", "mor", "nor", "ost", "per"],
    "CYRILLIC": ["ал", "бер", "вор", "гор", "дан", "ер", "жар", "зол", "ив", "кор", "лен", "мор", "нов", "ор", "пет", "рам"],
}
# Endings of made-up given names, by gender and script.
ENDINGS = {
    ("m", "LATIN"): ["o", "us", "ian"], ("f", "LATIN"): ["a", "ina", "elle"],
    ("m", "CYRILLIC"): ["ий", "ан", "ей"], ("f", "CYRILLIC"): ["а", "ия", "ина"],
}

_NAME = r"[^\W\d_][^\W\d_]+(?:-[^\W\d_]+)?"
_TITLE = "|".join(t for side in TITLES.values() for t in sorted(side, key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERN = re.compile(
    rf"""
    (?P<email>(?<![\w.%+-])[\w.%+-]{{1,64}}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)
    | (?P<secret>\bAKIA[A-Z0-9]{{16}}\b | (?<=password=)[^\s"']+ | (?<=password:\ )[^\s"']+ | (?<=token\ =\ ")[^"\n]+(?=") | (?<=token=)[^\s"']+)
    | (?P<ip>(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d.]*\d))
    | (?P<iban>\b[A-Z]{{2}}\d{{2}}(?:\ ?[A-Z0-9]{{4}}){{3,7}}(?:\ ?[A-Z0-9]{{1,3}})?\b)
    | (?P<phone>(?<![\w+])\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)|\d{{1,4}})(?:[ .-]?\d{{2,4}}){{1,4}}(?!\w) | (?<![\w(])\(?\d{{3}}\)?[ .-]\d{{3}}[ .-]\d{{4}}(?!\w))
    | (?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
    | (?P<card>(?<![\w.-])\d(?:[ -]?\d){{12,18}}(?![\w-]))
    | (?P<person>\b(?P<title>{_TITLE})\.?\ (?P<one>{_NAME})(?:\ (?P<two>(?=[^\W\d_a-z]){_NAME}))?)
    """,
    re.X,
)
_TRIGGERS = ["@", "AKIA", "password", "token", *TITLES["m"], *TITLES["f"], *"0123456789"]

FOUND = "doc_id long, kind string, entity string"
DRAWS_BEFORE_GROWTH = 16
FROM_POOL = 4
"""Draws of a given name from the list of names; later ones are made up of syllables, as surnames are."""


def _script(word: str) -> str:
    return "CYRILLIC" if unicodedata.name(word[0], "").startswith("CYRILLIC") else "LATIN"


def _parts(match: re.Match) -> Iterator[tuple[int, int, str, str]]:
    """Spans of one match with kind and canonical form; a person has one per name."""
    kind = match.lastgroup if match.lastgroup not in ("title", "one", "two") else "person"
    if kind != "person":
        text = match[0]
        if kind in ("phone", "card", "ssn"):
            canonical = "".join(str(unicodedata.digit(c)) for c in text if c.isdigit())
        elif kind == "iban":
            canonical = text.replace(" ", "")
        else:
            canonical = text if kind == "secret" else text.lower()
        yield match.start(), match.end(), kind, canonical
        return
    gender = "m" if match["title"] in TITLES["m"] else "f"
    names = [n for n in ("one", "two") if match[n]]
    for n in names:
        if not match[n][0].isupper():
            continue
        role = f"given-{gender}" if n == "one" and len(names) == 2 else "surname"
        yield match.start(n), match.end(n), f"{role}-{_script(match[n])}", match[n].lower()


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Entities of a text: (start, end, kind, canonical form), in order, without overlaps."""
    if not any(t in text for t in _TRIGGERS):
        return []
    return [part for match in PATTERN.finditer(text) for part in _parts(match)]


def _find_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {
            (doc, kind, entity)
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            if text
            for _, _, kind, entity in find(text)
        }
        columns = list(zip(*rows)) or [(), (), ()]
        kinds = [pa.int64(), pa.string(), pa.string()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "kind", "entity"])


class _Stream:
    """Numbers from a keyed hash of what is to be replaced."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.seed, self.left, self.block = key, "\x1f".join(what).encode("utf-8", "replace"), 0, 0

    def below(self, n: int) -> int:
        if self.left < 1 << 64:
            self.block += 1
            digest = hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha512).digest()
            self.left = int.from_bytes(digest, "big")
        self.left, out = divmod(self.left, n)
        return out


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def _mod97(text: str) -> int:
    """Remainder of an account number read as digits, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in text)) % 97


def draw(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """A surrogate in canonical form: the same for the same key, entity and attempt, of the same kind and shape."""
    s = _Stream(key, kind, entity, str(attempt))
    longer = attempt // DRAWS_BEFORE_GROWTH  # a full domain grows instead of colliding for ever

    def shaped(text: str) -> str:
        out = []
        for c in text:
            if c.isdigit():
                out.append(str(s.below(10)))
            elif c.isalpha():
                letter = chr(97 + s.below(26))
                out.append(letter.upper() if c.isupper() else letter)
            else:
                out.append(c)
        return "".join(out)

    if kind == "email":
        local, _, domain = entity.partition("@")
        host = domain.split(".")
        return shaped(local + "x" * longer) + "@" + ".".join([*[shaped(h) for h in host[:-2]], *host[-2:]])
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "phone":
        kept = len(entity) - 10 if len(entity) > 10 else 0  # the country's digits
        return entity[:kept] + shaped(entity[kept:] + "0" * longer)
    if kind == "card":
        body = entity[0] + shaped(entity[1:-1] + "0" * longer)
        last = (10 - _luhn(body + "0")) % 10
        return body + str(last if _luhn(entity) == 0 else (last + 1 + s.below(9)) % 10)
    if kind == "iban":
        body = shaped(entity[4:] + "0" * longer)
        checked = 98 - _mod97(body + entity[:2] + "00")
        return entity[:2] + f"{checked if _mod97(entity[4:] + entity[:4]) == 1 else (checked + s.below(96)) % 97 + 2:02}" + body
    if kind == "secret" and entity.startswith("AKIA"):
        return "AKIA" + shaped(entity[4:] + "A" * longer)
    if kind == "secret" and re.fullmatch("[0-9a-f]+", entity):
        return "".join("0123456789abcdef"[s.below(16)] for _ in range(len(entity) + longer))
    if kind.startswith("given"):
        _, gender, script = kind.split("-")
        pool, parts = GIVEN[gender, script], SURNAME_PARTS[script]
        if attempt < FROM_POOL:
            return pool[s.below(len(pool))]
        made = "".join(parts[s.below(len(parts))] for _ in range(2 + attempt // DRAWS_BEFORE_GROWTH)).capitalize()
        return made + ENDINGS[gender, script][s.below(len(ENDINGS[gender, script]))]
    if kind.startswith("surname"):
        script = kind.split("-")[1]
        made = "".join(SURNAME_PARTS[script][s.below(len(SURNAME_PARTS[script]))] for _ in range(3 + longer)).capitalize()
        return made + ("" if script == "LATIN" else "ова" if entity.endswith(("а", "я")) else "ов")
    return shaped(entity + "0" * longer)


def render(kind: str, mention: str, surrogate: str) -> str:
    """Writes a surrogate in the format of a mention; more digits than the mention has follow at its end."""
    if kind in ("phone", "card", "ssn", "iban"):
        left = list(surrogate)
        out = [left.pop(0) if left and (c.isalnum() if kind == "iban" else c.isdigit()) else c for c in mention]
        return "".join(out + left)
    if kind == "email":
        cased = [a.upper() if b.isupper() else a for a, b in zip(surrogate, mention)]
        return "".join(cased) + surrogate[len(cased) :] if len(surrogate) == len(mention) else surrogate
    if kind.startswith(("given", "surname")) and len(mention) > 1 and mention.isupper():
        return surrogate.upper()
    return surrogate


def _canonical(kind: str, surrogate: str) -> str:
    return surrogate.lower() if kind.startswith(("given", "surname", "email")) else surrogate


def _draw_all(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("kind", "entity", "attempt")])
        drawn = [draw(key, kind, entity, attempt) for kind, entity, attempt in rows]
        marks = [_canonical(k, d) for k, d in zip(batch.column("kind").to_pylist(), drawn)]
        columns = [batch.column(c) for c in ("kind", "entity", "attempt")] + [pa.array(drawn, pa.string()), pa.array(marks, pa.string())]
        yield pa.record_batch(columns, names=["kind", "entity", "attempt", "surrogate", "mark"])


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """One distinct surrogate per distinct (kind, entity) of ``found``: kind, entity, surrogate.

    A draw fails if an entity of that kind has that very form or if the draw is taken, by an
    earlier round or by another entity of this one (the smaller keeps it); failed entities
    draw again with the next attempt number.
    """
    entities = stage(found.select("kind", "entity").distinct(), "entities")[0]
    waiting, number, done = entities, 0, None
    while True:
        drawn = waiting.select("kind", "entity", F.lit(number).alias("attempt")).mapInArrow(
            functools.partial(_draw_all, key=key), "kind string, entity string, attempt int, surrogate string, mark string"
        )
        drawn, n = stage(drawn, "drawn")
        if not n:
            return (done if done is not None else drawn).select("kind", "entity", "surrogate")
        taken = entities.select("kind", F.col("entity").alias("mark"))
        if done is not None:
            taken = taken.unionAll(done.select("kind", "mark"))
        first = drawn.join(taken, ["kind", "mark"], "left_anti").groupBy("kind", "mark").agg(F.min("entity").alias("entity"))
        good = stage(drawn.join(first, ["kind", "mark", "entity"]), "good")[0]
        done = good if done is None else done.unionByName(good)
        waiting, n = stage(drawn.join(good, ["kind", "entity"], "left_anti"), "waiting")
        if not n:
            return done.select("kind", "entity", "surrogate")
        number += 1


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        texts, counts = [], []
        for text, pairs in zip(batch.column("text").to_pylist(), batch.column("_surrogates").to_pylist()):
            spans = find(text) if text and pairs else []
            if not spans:
                texts.append(text)
                counts.append(0)
                continue
            known = {(p["kind"], p["entity"]): p["surrogate"] for p in pairs}
            out, at = [], 0
            for start, end, kind, entity in spans:
                out += [text[at:start], render(kind, text[start:end], known[kind, entity])]
                at = end
            texts.append("".join([*out, text[at:]]))
            counts.append(len(spans))
        columns = [batch.column(n) for n in names]
        columns[names.index("text")] = pa.array(texts, pa.string())
        columns[names.index("_surrogates")] = pa.array(counts, pa.int64())
        names = ["_n_replaced" if n == "_surrogates" else n for n in names]
        yield pa.record_batch(columns, names=names)


def mentions(docs: DataFrame) -> DataFrame:
    """The distinct entities of each document: doc_id, kind, entity (canonical)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").mapInArrow(_find_all, FOUND)


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` (any columns) with entities in ``text`` replaced, and their number as ``_n_replaced``.

    Null and empty texts stay. Rows that share a doc_id (null too) are replaced alike. Only documents
    that have entities meet their surrogates in a join (and go to Python); the others pass through.
    """
    found = stage(mentions(docs), "mentions")[0]
    table = assign(found, key)
    own = stage(
        found.join(table, ["kind", "entity"]).groupBy(F.col("doc_id").alias("_owner"))
        .agg(F.collect_set(F.struct("kind", "entity", "surrogate")).alias("_surrogates")), "surrogates",
    )[0]
    owner = docs["doc_id"].cast("long")
    marked = flagged(docs.withColumn("_doc", owner), own.select("_owner"), "_doc", "_has").withColumn("_has", F.col("_has") | F.col("_doc").isNull())
    some = marked.where("_has").join(own, F.col("_doc").eqNullSafe(F.col("_owner")), "left")
    schema = docs.select(*docs.columns, F.lit(0).cast("long").alias("_n_replaced")).schema
    replaced = some.select(*docs.columns, "_surrogates").mapInArrow(_replace, schema)
    return replaced.unionAll(marked.where("NOT _has").select(*docs.columns, F.lit(0).cast("long").alias("_n_replaced")))

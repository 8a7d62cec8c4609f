"""Conversation structure repair: the cheapest edits that give alternating user and assistant turns.

Rows are dealt by conversation and sorted by turn, and a stream over each partition carries
a small state from one Arrow batch to the next: for each of four output states the least
cost so far and how the four cheapest edit strings compare. Each row adds four back-pointers
in four bytes. A conversation of at most ``CHUNK`` rows is traced back at once; a larger one
spills its pointers as rows, one per ``CHUNK``, to a table in the shared folder, and a second
stream reads them from the last chunk to the first. A third stream over the sorted rows
applies the edits. So no task holds more than a chunk of a conversation, beside its audit string.

Edits: Keep, Rerole, Delete, Insert. Output states: nothing yet, after a leading system turn,
after a user turn, after an assistant turn. An edit's letter fixes the role it gives, so among
the cheapest edit strings the least in ASCII is well defined; of two equally cheap strings that
lead to the same state after the same rows neither begins with the other (what follows would be
inserts, which cost), so the lesser one stays the lesser whatever follows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.session import stage

CHUNK = 65_536
REROLE, DELETE, INSERT, OPEN_END = 3, 4, 3, 3

START, SYSTEM, USER, ASSISTANT = range(4)
_TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the state after one more turn in alternation
_KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
WORDS = ["D", "K", "R", "ID", "IK", "IR"]
"""Edits at one row: perhaps an insert before it, then its own letter."""

MUST_GO = ""  # the symbol of a row that has to be deleted; others are initial + "." or initial + "~" (open end)


def _longer(left: str, right: str):
    """-1 or 1 as strings compare; ("<", rest) or (">", rest) where one begins with the other."""
    if left == right:
        return 0
    if right.startswith(left):
        return ("<", right[len(left) :])
    if left.startswith(right):
        return (">", left[len(right) :])
    return -1 if left < right else 1


def _compare(order: dict, a: tuple[int, str], b: tuple[int, str]):
    """How the strings (survivor of state a[0]) + a[1] and (survivor of b[0]) + b[1] compare."""
    (p, v), (q, w) = a, b
    known = 0 if p == q else order[p, q]
    if known in (-1, 1):
        return known
    if known == 0:
        return _longer(v, w)
    side, rest = known
    return _longer(v, rest + w) if side == "<" else _longer(rest + v, w)


@dataclass(frozen=True)
class Front:
    """The four survivors: costs above the least one (None: no way there), and their pairwise order."""

    costs: tuple
    order: tuple

    def step(self, symbol: str) -> tuple[Front, int, int]:
        """The front after one more row, by how much the least cost grew, and the row's packed pointers."""
        order = dict(self.order)
        ways: list[list[tuple[int, int, str]]] = [[], [], [], []]
        for p, cost in enumerate(self.costs):
            if cost is None:
                continue
            for q, before, paid in ((p, "", cost), (_TURN[p], "I", cost + INSERT)):
                ways[q].append((paid + DELETE, p, before + "D"))
                if symbol != MUST_GO:
                    extra = OPEN_END if symbol[1] == "~" else 0
                    ways[_TURN[q]].append((paid + REROLE + extra, p, before + "R"))
                    kept = _KEEP.get(symbol[0], {}).get(q)
                    if kept is not None:
                        ways[kept].append((paid + extra, p, before + "K"))
        best: list = [None] * 4
        for state, some in enumerate(ways):
            for way in some:
                old = best[state]
                if old is None or way[0] < old[0] or (way[0] == old[0] and _compare(order, way[1:], old[1:]) == -1):
                    best[state] = way
        alive = [s for s in range(4) if best[s]]
        least = min(best[s][0] for s in alive)
        pairs = tuple(((a, b), _compare(order, best[a][1:], best[b][1:])) for a in alive for b in alive if a != b)
        packed = sum((best[s][1] | WORDS.index(best[s][2]) << 2) << (5 * s) for s in alive)
        return Front(tuple(best[s][0] - least if best[s] else None for s in range(4)), pairs), least, packed

    def end(self) -> tuple[int, int, str]:
        """Cost above the least, state to trace from and last letters of the best complete edit string."""
        order = dict(self.order)
        ways = [(self.costs[s], s, "") for s in (START, ASSISTANT) if self.costs[s] is not None]
        if self.costs[USER] is not None:
            ways.append((self.costs[USER] + INSERT, USER, "I"))
        best = ways[0]
        for way in ways[1:]:
            if way[0] < best[0] or (way[0] == best[0] and _compare(order, way[1:], best[1:]) == -1):
                best = way
        return best


BEGIN = Front((0, None, None, None), ())


@functools.lru_cache(100_000)
def _step(front: Front, symbol: str) -> tuple[Front, int, int]:
    return front.step(symbol)


def _trace(pointers: np.ndarray, state: int) -> tuple[str, int]:
    """The edits of a run of rows that end in ``state``, and the state they began in."""
    words = []
    for packed in pointers[::-1].tolist():
        pointer = packed >> (5 * state) & 31
        words.append(WORDS[pointer >> 2])
        state = pointer & 3
    return "".join(words[::-1]), state


@dataclass
class _Open:
    """What the first stream carries of the conversation it is in."""

    key: str | None
    front: Front = BEGIN
    cost: int = 0
    chunk: int = 0
    pointers: list[int] = field(default_factory=list)
    turns: list = field(default_factory=lambda: [None, None, 0])
    counts: dict = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0))
    last: tuple = ()

    def add(self, turn, role: str, digest: bytes, blank: bool, open_end: bool, seen: bool) -> None:
        if self.last and self.last[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        if turn is not None and (not self.last or turn != self.last[0]):
            number = int(turn)
            self.turns = [number if self.turns[0] is None else self.turns[0], number, self.turns[2] + 1]
        seen = seen or self.last == (turn, role, digest)
        self.last = (turn, role, digest)
        if blank or seen:
            self.counts["blank" if blank else "duplicate"] += 1
            symbol = MUST_GO
        else:
            self.counts["truncated"] += open_end
            initial = role[:1] if role[:1] in _KEEP and role else "?"
            symbol = initial + ("~" if open_end else ".")
        self.front, grown, packed = _step(self.front, symbol)
        self.cost += grown
        self.pointers.append(packed)

    def spilled(self, **more) -> dict:
        row = {"key": self.key, "chunk": self.chunk, "pointers": np.array(self.pointers, "<u4").tobytes()} | more
        self.pointers, self.chunk = [], self.chunk + 1
        return row

    def close(self) -> dict:
        above, state, tail = self.front.end()
        low, high, n = self.turns
        told = {
            **self.counts, "gaps": high - low + 1 - n if n else 0, "cost": self.cost + above, "state": state, "tail": tail,
        }
        if self.chunk:
            return self.spilled(**told)
        return {"key": self.key, "chunk": 0, "audit": _trace(np.array(self.pointers, "<u4"), state)[0] + tail, **told}


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_PLANNED = "key string, chunk int, pointers binary, audit string, state int, tail string, " + ", ".join(f"{c} long" for c in COUNTS)


def _table(rows: list[dict], schema: str) -> pd.DataFrame:
    return pd.DataFrame({c.split()[0]: pd.Series([r.get(c.split()[0]) for r in rows], dtype=object) for c in schema.split(", ")})


def _plan(frames: Iterator[pd.DataFrame], chunk: int) -> Iterator[pd.DataFrame]:
    """First stream: rows by (key, turn, ...) to plans of whole conversations and spilled pointers of large ones."""
    now: _Open | None = None
    for frame in frames:
        out = []
        for key, *row in zip(*[frame[c].tolist() for c in ("key", "turn", "role", "digest", "blank", "open_end", "seen")]):
            if now is None or key != now.key:
                if now is not None:
                    out.append(now.close())
                now = _Open(key)
            elif len(now.pointers) == chunk:
                out.append(now.spilled())
            now.add(*row)
        if out:
            yield _table(out, _PLANNED)
    if now is not None:
        yield _table([now.close()], _PLANNED)


def _retrace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Second stream: spilled pointers by (key, chunk falling) to the edits of each chunk."""
    key, state = object(), START
    for frame in frames:
        out = []
        for k, chunk, pointers, ends, tail in zip(*[frame[c].tolist() for c in ("key", "chunk", "pointers", "state", "tail")]):
            if k != key:  # the last chunk of a conversation knows where to begin
                key, state = k, int(ends)
            edits, state = _trace(np.frombuffer(pointers, "<u4"), state)
            out.append({"key": k, "chunk": chunk, "edits": edits + (tail or "")})
        yield _table(out, "key string, chunk int, edits string")


@dataclass
class _Replay:
    """Applies an audit string to the rows of its conversation, one at a time."""

    head: dict
    at: int = 0
    state: int = START

    def _turned(self) -> str:
        self.state = _TURN[self.state]
        return _ROLE[self.state]

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.head["audit"]) and self.head["audit"][self.at] == "I":
            self.at += 1
            yield "I", self._turned(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        edit = self.head["audit"][self.at]
        self.at += 1
        if edit == "R":
            yield edit, self._turned(), text
        elif edit == "K":
            self.state = _KEEP[role[0]][self.state]
            yield edit, role, text


_SUMMARY = "key string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
_REPAIRED = "key string, place long, edit string, role string, text string"


def _replay(frames: Iterator[pd.DataFrame], rows_out: bool) -> Iterator[pd.DataFrame]:
    """Third stream: each conversation's plan, then its rows, to its repaired rows or its summary."""
    now: _Replay | None = None
    place, digest = 0, hashlib.sha256()
    schema = _REPAIRED if rows_out else _SUMMARY

    def told(some: Iterator[tuple[str, str, str]]) -> Iterator[dict]:
        nonlocal place
        for edit, role, text in some:
            if rows_out:
                yield {"key": now.head["key"], "place": place, "edit": edit, "role": role, "text": text}
            else:
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "replace"))
            place += 1

    def closed() -> list[dict]:
        if now is None:
            return []
        out = list(told(now.inserts()))
        return out if rows_out else [{**now.head, "repaired_sha256": digest.hexdigest()}]

    for frame in frames:
        out: list[dict] = []
        columns = ["key", "kind", "role", "text", "audit", *COUNTS]
        for key, kind, role, text, audit, *counts in zip(*[frame[c].tolist() for c in columns]):
            if kind == 0:
                out += closed()
                now = _Replay({"key": key, "audit": audit, **{c: int(n) for c, n in zip(COUNTS, counts)}})
                place, digest = 0, hashlib.sha256()
            else:
                out += told(now.row(role, text))
        if out:
            yield _table(out, schema)
    last = closed()
    if last:
        yield _table(last, schema)


# -- the jobs


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by the checksum of ``conv_id:turn``; nulls are one space.

    A twentieth each: dropped, emptied, without ``.!?``, twice, given the role user.
    """
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(filled[0], F.lit(":"), filled[1]).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(0), times)).alias("_time"),
    ).where("_time > 0").drop("_time")


def _sorted(rows: DataFrame, *order: Column | str) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", *order)


def plan(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The cheapest edits of every conversation that has rows: key (conv_id as text), the counts, cost and audit."""
    space = "\x20\x09\x0a\x0b\x0c\x0d"
    line = _keyed(rows).select(
        "key", "turn", "role", "digest",
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.right(F.rtrim("text", F.lit(space)), F.lit(1)).isin(".", "!", "?")).alias("open_end"),
    )
    # where equal rows occur more than once: the first turn they are at
    known = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    several = (
        line.where("NOT blank").groupBy(F.col("key").alias("_k"), F.col("role").alias("_r"), F.col("digest").alias("_d"))
        .agg(F.min(known).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    same = F.col("key").eqNullSafe(F.col("_k")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    marked = line.join(several, same, "left").withColumn("seen", F.coalesce(F.col("first") < known, F.lit(False)))
    ordered = _sorted(marked.select("key", "turn", "role", "digest", "blank", "open_end", "seen"), F.asc_nulls_first("turn"), "role", "digest")
    # turns travel as text, which pandas keeps whole beside nulls
    texts = ordered.withColumn("turn", F.col("turn").cast("string"))
    planned = stage(texts.mapInPandas(functools.partial(_plan, chunk=chunk), _PLANNED), "plans")[0]
    whole = planned.where("pointers IS NULL").select("key", "audit", *COUNTS)
    spilled = planned.where("pointers IS NOT NULL")
    if spilled.isEmpty():
        return whole
    traced = _sorted(spilled.select("key", "chunk", "pointers", "state", "tail"), F.desc("chunk"))
    edits = stage(traced.mapInPandas(_retrace, "key string, chunk int, edits string"), "edits")[0]
    audits = edits.groupBy(F.col("key").alias("_k")).agg(
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("chunk", "edits"))), lambda e: e["edits"])).alias("_audit")
    )
    large = spilled.where("state IS NOT NULL").join(audits, F.col("key").eqNullSafe(F.col("_k")))
    return whole.unionByName(large.select("key", F.col("_audit").alias("audit"), *COUNTS))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").cast("string").alias("key"), "turn", "role", "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


def _replayed(rows: DataFrame, plans: DataFrame, rows_out: bool) -> DataFrame:
    body = _keyed(rows).select("key", F.lit(1).alias("kind"), "turn", "role", "digest", "text", F.lit(None).cast("string").alias("audit"), *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    heads = plans.select("key", F.lit(0).alias("kind"), *[F.lit(None).cast(body.schema[c].dataType).alias(c) for c in ("turn", "role", "digest", "text")], "audit", *COUNTS)
    ordered = _sorted(heads.unionByName(body), "kind", F.asc_nulls_first("turn"), "role", "digest")
    return ordered.drop("turn", "digest").mapInPandas(functools.partial(_replay, rows_out=rows_out), _REPAIRED if rows_out else _SUMMARY)


def repaired(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role, text.

    ``rows``: (conv_id, turn, role, text) without null roles and texts, as ``damaged`` gives them.
    """
    rows = rows.select("conv_id", "turn", "role", "text")
    found = _replayed(rows, plan(rows, chunk), True)
    return found.select(F.col("key").cast(rows.schema["conv_id"].dataType).alias("conv_id"), "place", "edit", "role", "text")


def repair(rows: DataFrame, of: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first; rows of one turn by role and digest of the text. Rows without conv_id
    are one conversation. ``of``: conversations to report beside those of ``rows`` (a column conv_id); without rows they
    have zeros, an empty audit and the hash of nothing. A role's first character counts; a role that is empty, or neither system,
    user nor assistant by that character, can't be kept. Empty tables give no rows.
    """
    rows = rows.select("conv_id", "turn", "role", "text")
    names = (rows if of is None else of).select(F.col("conv_id").cast("string").alias("_name")).distinct()
    plans = names.join(plan(rows, chunk), F.col("_name").eqNullSafe(F.col("key")), "left" if of is not None else "inner")
    filled = plans.select(F.col("_name").alias("key"), F.coalesce("audit", F.lit("")).alias("audit"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS])
    found = _replayed(rows, filled, False)
    return found.select(F.col("key").cast(rows.schema["conv_id"].dataType).alias("conv_id"), *COUNTS, "audit", "repaired_sha256")


def oracle_sql() -> str:
    """``repair(damaged(rows), rows)`` of ``conversations`` in plain SQL: least costs from the end, then letter by letter from the start."""
    byte = "list_transform(string_split(k, ''), lambda c: CAST(ord(c) AS BIGINT))"
    bits = "list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(acc, b))"
    crc = f"xor(list_reduce({byte}, lambda acc, b: {bits}, CAST(4294967295 AS BIGINT)), 4294967295)"
    big = 1_000_000_000
    turned = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
    keeps = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}

    def straight(s: int) -> str:
        kept = " ".join(f"WHEN '{initial}' THEN extra + c[{to + 1}]" for initial, to in keeps[s].items())
        return f"least({DELETE} + c[{s + 1}], CASE WHEN gone THEN {big} ELSE least({REROLE} + extra + c[{turned[s] + 1}], CASE initial {kept} ELSE {big} END) END)"

    def by_state(choice: dict, column: str = "s") -> str:
        return f"CASE {column} " + " ".join(f"WHEN {s} THEN {value}" for s, value in choice.items()) + " END"

    keep_of = by_state({s: "CASE initial " + " ".join(f"WHEN '{i}' THEN {to}" for i, to in some.items()) + " END" for s, some in keeps.items()})
    name = by_state({USER: "'user'", ASSISTANT: "'assistant'"}, "to_state")
    return f"""
    WITH RECURSIVE filled AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
    ), hashed AS (SELECT *, {crc} % 20 AS kind FROM filled
    ), damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, left(role, 1) AS initial FROM damaged
    ), judged AS (
        SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' END AS fault,
            lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM placed
    ), steps AS (
        SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN {OPEN_END} ELSE 0 END AS extra FROM judged
    ), counted AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
            count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(illegal) AS illegal FROM steps GROUP BY conv_id
    ), back AS (
        SELECT conv_id, n + 1 AS i, [0, {2 * INSERT}, {INSERT}, 0] AS c FROM counted
        UNION ALL
        SELECT conv_id, i, [least(a, {INSERT} + u, {2 * INSERT} + v), least(b, {INSERT} + u, {2 * INSERT} + v), least(u, {INSERT} + v), least(v, {INSERT} + u)]
        FROM (
            SELECT s.conv_id, s.i, {straight(START)} AS a, {straight(SYSTEM)} AS b, {straight(USER)} AS u, {straight(ASSISTANT)} AS v
            FROM back b JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i - 1)
    ), walk AS (
        SELECT conv_id, CAST(1 AS BIGINT) AS i, {START} AS s, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM counted
        UNION ALL
        SELECT conv_id, CASE WHEN letter = 'I' THEN i ELSE i + 1 END, CASE WHEN letter = 'D' THEN s ELSE to_state END, audit || letter,
            CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
                WHEN 'R' THEN list_append(lines, {name} || ':' || text) ELSE list_append(lines, {name} || ':') END
        FROM (SELECT *, CASE WHEN letter = 'K' THEN kept ELSE turned END AS to_state FROM (
            SELECT *, CASE WHEN {DELETE} + next_c[s + 1] = c[s + 1] THEN 'D' WHEN {INSERT} + c[turned + 1] = c[s + 1] THEN 'I'
                WHEN NOT gone AND extra + next_c[kept + 1] = c[s + 1] THEN 'K' WHEN NOT gone AND {REROLE} + extra + next_c[turned + 1] = c[s + 1] THEN 'R' END AS letter
            FROM (
                SELECT w.*, t.role, t.text, t.gone, t.extra, h.c, x.c AS next_c, {by_state(turned, "w.s")} AS turned, {keep_of.replace("CASE s ", "CASE w.s ").replace("CASE initial", "CASE t.initial")} AS kept
                FROM walk w JOIN back h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.i = w.i
                LEFT JOIN steps t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i
                LEFT JOIN back x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1)))
        WHERE letter IS NOT NULL
    ), done AS (SELECT conv_id, arg_max(audit, len(audit)) AS audit, arg_max(lines, len(audit)) AS lines FROM walk GROUP BY conv_id
    ), costs AS (SELECT conv_id, c[1] AS cost FROM back WHERE i = 1)
    SELECT o.conv_id, coalesce(k.gaps, 0) AS gaps, coalesce(k.blank, 0) AS blank, coalesce(k.duplicate, 0) AS duplicate, coalesce(k.truncated, 0) AS truncated,
        coalesce(k.illegal, 0) AS illegal, CAST(coalesce(a.cost, 0) AS BIGINT) AS cost, coalesce(d.audit, '') AS audit, sha256(coalesce(array_to_string(d.lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted k ON k.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN costs a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
    """

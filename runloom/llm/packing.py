"""Best-fit packing into fixed-length sequences, certified by dual-feasible lower bounds.

Pieces are dealt evenly to groups of a few thousand rows. Each group is packed by
best-fit decreasing, and dual-feasible functions bound its number of bins from below:
a group that meets its bound is certified. Groups with a gap give up their bins that
are not full, every group gives up its emptiest one; these documents are exchanged
(dealt anew, mixed over groups) and packed again, as long as that saves bins.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import slices
from runloom.session import stage

CAPACITY = 2048
GROUP_ROWS = 4096
SLICE_BYTES = 4 << 20
WORD_END, LINE_WORDS = "</w>", 256
CACHED_WORDS = 300_000
"""Words whose ids a Python worker remembers before a slice of texts; when full it starts afresh."""

_MARKS = r"""[!"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*"""
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIMPLE = f"^(?P<word>[{_LETTERS}]+)(?P<marks>{_MARKS})$"
_WORD = f"^(?:[{_LETTERS}]+|{_MARKS})$"


class ChunkIds:
    """Token ids of texts, one white-space chunk at a time.

    The tokenizer drops white space and neither its normaliser nor its merges look past
    it, so a text's ids are those of its chunks in order. A chunk of Latin letters plus
    ASCII punctuation falls into these two parts, each one word to the tokenizer: lower case, composed, no
    contraction. Many such words are encoded as one line, which only has to be cut at spaces, and are told
    apart by the tokens that end a word. Every other chunk is encoded whole, by the tokenizer as it is.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.of_words = Tokenizer.from_str(model), Tokenizer.from_str(model)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)
        self.of_words.normalizer = None
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), as_bytes])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        """The words known so far: none but the empty one; their ids lie one after another in ``flat``."""
        self.words, self.flat, self.starts = pa.array([""], pa.string()), np.zeros(0, "<u4"), np.zeros(2, np.int64)

    def _learn(self, new: pa.Array) -> None:
        plain = pc.match_substring_regex(new, _WORD)
        words, others = new.filter(plain), new.filter(pc.invert(plain))
        listed = words.to_pylist()
        lines = [" ".join(listed[lo : lo + LINE_WORDS]) for lo in range(0, len(listed), LINE_WORDS)]
        found = [np.array(e.ids, "<u4") for e in self.of_words.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, "<u4"), *found])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            raise ValueError(f"the tokenizer does not end every word in {WORD_END}")
        rest = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(others.to_pylist(), add_special_tokens=False)]
        ends = np.concatenate([ends, len(ids) + np.cumsum([len(r) for r in rest], dtype=np.int64)])
        self.words = pa.concat_arrays([self.words, words, others])
        self.starts = np.concatenate([self.starts, len(self.flat) + ends])
        self.flat = np.concatenate([self.flat, ids, *rest])

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Where the ids of different words lie; those that are new are learnt."""
        if len(self.words) > CACHED_WORDS:
            self._forget()
        new = parts.filter(pc.is_null(pc.index_in(parts, self.words)))
        if len(new):
            self._learn(new)
        return pc.index_in(parts, self.words).to_numpy()

    def encode(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        """The ids of each text, four little-endian bytes each."""
        if not isinstance(texts, pa.Array):
            texts = pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())
        cut = pc.ascii_split_whitespace(texts)
        chunks = cut.flatten().dictionary_encode()
        simple = pc.extract_regex(chunks.dictionary, _SIMPLE)
        fits = simple.is_valid()
        heads = pc.if_else(fits, pc.utf8_lower(simple.field("word")), chunks.dictionary)
        parts = pa.concat_arrays([heads, pc.if_else(fits, simple.field("marks"), "")]).dictionary_encode()
        places = self._places(parts.dictionary)[parts.indices.to_numpy()]
        which = chunks.indices.to_numpy()
        order = np.stack([places[: len(heads)][which], places[len(heads) :][which]], axis=1).ravel()  # word, marks, word, marks ...
        sizes = np.diff(self.starts)[order]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.starts[order] - ends[:-1], sizes) + np.arange(ends[-1])]
        for lo, hi in pairwise(ends[2 * (cut.offsets.to_numpy() - cut.offsets[0].as_py())].tolist()):
            yield ids[lo:hi].tobytes()


_LOADED: dict[int, ChunkIds] = {}


def _loaded(model: str) -> ChunkIds:
    """One tokenizer and its caches per Python worker."""
    key = zlib.crc32(model.encode())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ChunkIds(model)
    return _LOADED[key]


def _cut(batches: Iterator[pa.RecordBatch], model, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = _loaded(model.value)
    for batch in slices(batches, "text", SLICE_BYTES):
        rows: list[tuple] = []
        texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
            ids += b"\0\0\0\0"
            for piece, lo in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[lo : lo + 4 * capacity]
                rows.append((doc_id, piece, lo // 4, len(part) // 4, zlib.crc32(part), part))
        columns = [list(c) for c in zip(*rows)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        n = 6 if with_ids else 5
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns[:n], kinds)], names=names[:n])


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every document as pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 (and ids).

    A document's ids end with an id 0; a null text is empty and so one piece of length 1.
    Rows that repeat give their pieces as often.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(functools.partial(_cut, model=model, capacity=capacity, with_ids=with_ids), schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions.

    One counts pieces over ``capacity - a`` as whole bins and drops those under ``a`` (a = 0
    is the plain sum); the other rounds sizes down to multiples of 1/k as far as allowed.
    """
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    if not count.sum():
        return 0
    size = np.arange(capacity + 1)
    n, total = np.cumsum(count), np.cumsum(count * size)
    a = np.arange(0, capacity // 2 + 1)
    large = n[-1] - n[capacity - a]
    middle = total[capacity - a] - np.where(a > 0, total[np.maximum(a - 1, 0)], 0)
    best = int((large - (-middle // capacity)).max())
    for k in range(1, 31):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, capacity * (scaled // capacity))
        best = max(best, int(-(-int((value * count).sum()) // (k * capacity))))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each piece's bin and offset, and every bin's fill."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    mask = 0  # bit r: some bin has r free places
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
        else:
            b, free = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if free > size:
            room[free - size].append(b)
            mask |= 1 << (free - size)
    return bins, offsets, np.array(fill, np.int64)


PLACES = "bin long, offset long, fill long, emptiest boolean, n_bins long, bound long"


def _pack_group(rows: pa.Table, capacity: int) -> pa.Table:
    lengths = rows.column("length").to_numpy()
    bins, offsets, fill = best_fit(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    n = len(lengths)
    new = {
        "bin": bins, "offset": offsets, "fill": fill[bins], "emptiest": bins == int(fill.argmin()),
        "n_bins": np.full(n, len(fill)), "bound": np.full(n, bound),
    }
    for name, values in new.items():
        rows = rows.append_column(name, pa.array(values))
    return rows


def _round(rows: DataFrame, n: int, number: int, capacity: int, group_rows: int) -> tuple[DataFrame, int]:
    """Deals ``rows`` to groups and packs them; the bins they take."""
    groups = max(1, -(-n // group_rows))
    dealt = rows.withColumn("grp", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, grp long, " + PLACES

    def packed(rows: pa.Table) -> pa.Table:
        return _pack_group(rows, capacity)

    placed = dealt.groupBy("grp").applyInArrow(packed, schema)
    # groups are below 2^31, a group's bins below 2^22, rounds below 2^10
    named = placed.withColumn("sequence_id", (F.col("grp") * (1 << 22) + F.col("bin")) * (1 << 10) + number)
    staged = stage(named, f"packed{number}")[0]
    bins = staged.where("offset = 0").count()
    return staged, bins


def pack(cut: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, rounds: int | None = None) -> DataFrame:
    """Places pieces (1 to ``capacity`` long) in sequences: adds sequence_id, offset and certified.

    ``certified``: the group that the sequence was packed in took as few bins as its lower
    bound says any packing needs. Empty input gives no rows.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows, n = stage(cut.select(*columns), "pieces")
    placed, _ = _round(rows, n, 0, capacity, group_rows)
    done: list[DataFrame] = []
    loose_rule = (F.col("fill") < capacity) & ((F.col("n_bins") > F.col("bound")) | F.col("emptiest"))
    for number in range(1, rounds or 1 << 10):
        loose = placed.where(loose_rule)
        size, before = loose.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("offset") == 0, 1)), F.lit(0))).first()
        if before < 2:
            break
        again, after = _round(loose.select(*columns), size, number, capacity, group_rows)
        if after >= before:
            break
        done.append(placed.where(~loose_rule))
        placed = again
    parts = [p.select(*columns, "sequence_id", "offset", (F.col("n_bins") == F.col("bound")).alias("certified")) for p in [*done, placed]]
    return functools.reduce(DataFrame.unionAll, parts)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """Pieces and places of all documents. Null texts and empty ones are one piece of a single id; null ids and repeated rows are packed like others."""
    return pack(pieces(docs, tokenizer_file or default_tokenizer()))

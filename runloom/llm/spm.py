"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives one Viterbi pass.

The automaton holds all pieces. Its output links give every piece that ends at a position,
longest first, and each relaxes the best score there; positions are met in order, so one
pass over the text suffices. Characters without a piece fall back to bytes.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import slices

MARK = "▁"
CACHED_SEGMENTS = 300_000
SLICE_BYTES = 4 << 20


@dataclass(frozen=True)
class Vocabulary:
    """What is read from a model file; its size is that of the file."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    plain: tuple[bool, ...]
    byte_ids: tuple[int, ...]
    unknown: int


def load(model_file: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.vocab_size()
    special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
    by_byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
    return Vocabulary(
        tuple(sp.id_to_piece(i) for i in range(n)),
        tuple(sp.get_score(i) for i in range(n)),
        tuple(not s for s in special),
        tuple(by_byte[b] for b in range(256)) if len(by_byte) == 256 else (),
        sp.unk_id(),
    )


class Coder:
    """Encodes and decodes texts with one vocabulary; keeps the ids of frequent segments."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.vocabulary = v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(v.pieces):
            if v.plain[i] and piece:
                self.automaton.add_word(piece, (len(piece), v.scores[i], i))
        self.automaton.make_automaton()
        self.single = {p for p, plain in zip(v.pieces, v.plain) if plain and len(p) == 1}
        self.unknown_score = min(s for s, plain in zip(v.scores, v.plain) if plain) - 10.0
        # no piece has a mark after another character: the best path passes every such place
        self.splits = not any(MARK in p.lstrip(MARK) for p, plain in zip(v.pieces, v.plain) if plain)
        as_bytes = [p.replace(MARK, " ").encode() if plain else b"" for p, plain in zip(v.pieces, v.plain)]
        for b, i in enumerate(v.byte_ids):
            as_bytes[i] = bytes([b])
        as_bytes[v.unknown] = "⁇".encode()
        self.as_bytes = as_bytes
        self.known: dict[str, bytes] = {}

    def viterbi(self, text: str) -> tuple[list[int], float]:
        """The best-scoring ids of a marked text; on equal scores the longer last piece."""
        n = len(text)
        best, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        best[0], filled = 0.0, 0

        def fill(to: int) -> None:  # characters that no piece covers alone
            for p in range(filled, to):
                if text[p] not in self.single and best[p] + self.unknown_score > best[p + 1]:
                    best[p + 1], back[p + 1] = best[p] + self.unknown_score, (p, -1)

        for last, (size, score, piece) in self.automaton.iter(text):
            if last > filled:
                fill(last)
                filled = last
            start = last + 1 - size
            if best[start] + score > best[last + 1]:
                best[last + 1], back[last + 1] = best[start] + score, (start, piece)
        fill(n)
        out: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            if piece >= 0:
                out.append(piece)
            elif self.vocabulary.byte_ids:
                out += [self.vocabulary.byte_ids[b] for b in reversed(text[start:at].encode("utf-8", "replace"))]
            else:
                out.append(self.vocabulary.unknown)
            at = start
        return out[::-1], best[n]

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers. A mark goes before the text and replaces each space; no text, no ids."""
        if not text:
            return b""
        whole = MARK + text.replace(" ", MARK)
        segments = re.findall(f"{MARK}+[^{MARK}]*", whole) if self.splits else [whole]
        known, out = self.known, []
        for s in segments:
            ids = known.get(s)
            if ids is None:
                ids = array("i", self.viterbi(s)[0]).tobytes()
                if len(known) >= CACHED_SEGMENTS:
                    known.clear()
                if len(s) <= 64:
                    known[s] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces and bytes in order, marks as spaces, without the first one."""
        numbers = array("i")
        numbers.frombytes(ids)
        table = self.as_bytes
        text = b"".join([table[i] for i in numbers]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_CODERS: dict[int, Coder] = {}


def _coder(vocabulary: Vocabulary) -> Coder:
    """One coder per Python worker and vocabulary."""
    key = zlib.crc32("\n".join(vocabulary.pieces).encode())
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(vocabulary)
    return _CODERS[key]


def _encode(batches: Iterator[pa.RecordBatch], vocabulary, check: bool) -> Iterator[pa.RecordBatch]:
    coder = _coder(vocabulary.value)
    for batch in slices(batches, "text", SLICE_BYTES):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids = [coder.encode(t) for t in texts]
        columns = {"doc_id": batch.column("doc_id")}
        if check:
            columns["n_ids"] = pa.array([len(i) // 4 for i in ids], pa.int64())
            columns["ids_crc32"] = pa.array([zlib.crc32(i) for i in ids], pa.int64())
            same = [coder.decode(i) == t.replace(MARK, " ").encode("utf-8", "replace").decode() for i, t in zip(ids, texts)]
            columns["round_trip"] = pa.array(same, pa.bool_())
        else:
            columns["ids"] = pa.array([array("i", i).tolist() for i in ids], pa.list_(pa.int32()))
        yield pa.record_batch(list(columns.values()), names=list(columns))


def _decode(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    coder = _coder(vocabulary.value)
    for batch in batches:
        texts = [None if i is None else coder.decode(array("i", i).tobytes()) for i in batch.column("ids").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def _source(docs: DataFrame, column: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), column)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids) of every row; null and empty texts have no ids."""
    v = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return _source(docs, "text").mapInArrow(functools.partial(_encode, vocabulary=v, check=False), "doc_id long, ids array<int>")


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text) of rows of (doc_id, ids); null ids give null texts."""
    v = rows.sparkSession.sparkContext.broadcast(vocabulary)
    return _source(rows, "ids").mapInArrow(functools.partial(_decode, vocabulary=v), "doc_id long, text string")


def check(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Encodes and decodes every text in one pass: doc_id, n_ids, ids_crc32 (little-endian 32-bit ids), round_trip."""
    v = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean"
    return _source(docs, "text").mapInArrow(functools.partial(_encode, vocabulary=v, check=True), schema)

r"""Token counts of a sentencepiece BPE model, without making the tokens.

A chunk's characters are a linked list; a heap holds the adjacent pairs that are pieces, lowest rank first and of
equal ranks the leftmost. Each pop is one merge, so the count is the initial symbols less the merges; characters
without a piece count as their UTF-8 bytes. Pieces have the space mark only at their start, so a text falls into
chunks (spaces and the word after them) that can't affect each other, and the counts of short chunks are kept in a
table of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

MARK = "▁"
#: Chunks whose counts a Python worker remembers, and the longest that it remembers.
KEPT, KEPT_CHARS = 1_000_000, 40


class Counts(dict):
    """Chunk to count; what is missing is counted, and kept while there is room."""

    def __init__(self, pieces: dict[str, float], lead: str):
        super().__init__()
        self.pieces, self.lead = pieces, lead

    def __missing__(self, chunk: str) -> int:
        n = merged_count(self.lead + chunk, self.pieces)
        if len(self) < KEPT and len(chunk) <= KEPT_CHARS:
            self[chunk] = n
        return n


def merged_count(chunk: str, pieces: dict[str, float]) -> int:
    """Initial symbols less merges."""
    parts = list(chunk)
    total = len(parts)
    extra = {}  # bytes beyond the first of characters that are no pieces
    if not pieces.keys() >= set(parts):
        extra = {i: len(c.encode()) - 1 for i, c in enumerate(parts) if c not in pieces}
        total += sum(extra.values())
    get = pieces.get
    heap = [(r, i, p) for i, p in enumerate(map(add, parts, parts[1:])) if (r := get(p)) is not None]
    if not heap:
        return total
    heapify(heap)
    last = len(parts) - 1
    before, after = list(range(-1, last)), list(range(1, last + 2))
    while heap:
        _, i, p = heappop(heap)
        j = after[i]
        if j > last or not (x := parts[i]) or x + parts[j] != p:
            continue
        total -= 1 + extra.pop(i, 0) + extra.pop(j, 0) if extra else 1
        parts[i], parts[j] = p, ""
        k = after[i] = after[j]
        if k <= last:
            before[k] = i
            if (r := get(q := p + parts[k])) is not None:
                heappush(heap, (r, i, q))
        if (h := before[i]) >= 0 and (r := get(q := parts[h] + p)) is not None:
            heappush(heap, (r, h, q))
    return total


class PieceCounter:
    """Counts as SentencePieceProcessor(model_file).encode(text) would give pieces."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as model_pb

        model = model_pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with the identity normaliser, a dummy prefix and byte fallback is asked for")
        pieces = {p.piece: -p.score for p in model.pieces if p.type == 1}
        self.pieces = pieces
        self.apart = not any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)) for p in pieces)
        self.lines = not any("\n" in p for p in pieces)
        self.marked, self.bare = Counts(pieces, MARK), Counts(pieces, "")

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not (self.apart and self.lines):
            return merged_count((MARK + text).replace(" ", MARK), self.pieces)
        first, *rest = text.replace(MARK, " ").split("\n")
        n = len(rest) + self.words(first.split(" "))
        for line in rest:
            head, *words = line.split(" ")
            n += (self.bare[head] if head else 0) + self.words(words)
        return n

    def words(self, words: list[str]) -> int:
        """Each word has a space mark before it; an empty one is a further mark."""
        if "" not in words:
            return sum(map(self.marked.__getitem__, words))
        n = marks = 0
        for word in words:
            if word:
                n += self.marked[MARK * marks + word]
                marks = 0
            else:
                marks += 1
        return n + (self.marked[MARK * (marks - 1)] if marks else 0)


_counters: dict[str, PieceCounter] = {}


def counter(model_file: str) -> PieceCounter:
    if model_file not in _counters:
        _counters[model_file] = PieceCounter(model_file)
    return _counters[model_file]


def counted(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        count = counter(model if "/" in model else public_tokenizers.path(model)).count
        for batch in batches:
            texts = batch.column(1)
            yield pa.record_batch({
                "id": batch.column(0),
                "n_bytes": pc.binary_length(texts).cast(pa.int64()),
                "n_tokens": pa.array([count(t.as_py()) for t in texts], pa.int64()),
            })

    return run


def token_counts(docs: DataFrame, *, text: str = "text", key: str = "doc_id", model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_tokens, over_limit. Null and empty texts have none. No shuffle.

    model: a file of public_tokenizers, or a path that every executor can open. Any key type; repeated rows stay.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = rows.mapInArrow(counted(model), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""Phrase collocations by SON partitioning.

A shard is what one task reads, or as much of it as makes ENTRIES different phrases, counted block by block. Every shard is
mined whole, phrase length by length, at a local support lowered in proportion to its share of a language's words: a
phrase of MIN_COUNT in all has its share in some shard. What shards find frequent is united, with the counts they found; a phrase that can't reach
MIN_COUNT even if it stands just below the local support in all other shards goes, and a longer phrase is mined only where
both its parts are left. Then all candidates of all lengths are counted exactly over all texts.

A local support of 1 or less counts everything, so for a language of over LARGE words, whose shards are a small share of it
each, the union's counts are whole. Between the passes candidates travel as a bit field of their hashes, FIELD_BITS at most: two phrases
on one bit let too much through, never too little, and the exact count decides.

Letters A-Z are lower-cased; [.,;:!?\\x0A-\\x0D] end a piece, and words are [^\\x20\\x09]+ of a piece. Null texts are empty,
a null language is "und". Documents are counted as they come, repeats too, whatever their keys and other columns. A
language or table without a phrase frequent enough has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, ship

MIN_COUNT, LONGEST, TOP, WITHIN = 30, 4, 2000, 80
#: Bytes of text worked off at once, and taken apart at once; entries that a task holds; words a task reads where there are more tasks than the session has cores for.
BLOCK_BYTES, CHUNK_BYTES, ENTRIES, TASK_WORDS = 8 << 20, 1 << 20, 1 << 22, 1 << 26
#: Words of a language up to which shards have a local support of their own, and how many languages at most.
LARGE, LISTED = 1 << 27, 1000
FIELD_BITS = 27
#: What ends a piece becomes a line break, a tab a blank.
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
#: A word that no text in UTF-8 has, between pieces.
BREAK = b"\xff"
STEP = np.uint64(0x9E3779B97F4A7C15)


class _Vocabulary(dict):
    """Numbers of words in order of their coming; 0 is the break."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Field:
    """Bits of hashes, by their upper bits."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


class _Part:
    """A block's texts in one language: words by number."""

    def __init__(self) -> None:
        self.vocabulary, self.waiting, self.size, self.numbers = _Vocabulary({BREAK: 0}), [], 0, []

    def add(self, text: bytes) -> None:
        self.waiting.append(text)
        self.size += len(text)
        if self.size >= CHUNK_BYTES:
            self.settle()

    def settle(self) -> None:
        number = self.vocabulary
        words = (b"\n".join(self.waiting) + b"\n").lower().translate(ENDS).replace(b"\n", b" \xff ").split()
        self.numbers.append(np.fromiter((number[w] for w in words), np.int32, len(words)))
        self.waiting, self.size = [], 0

    def whole(self, lang: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words, their hashes, and the sequence of their numbers."""
        self.settle()
        seed = xxhash.xxh64_intdigest(lang.encode())
        words = list(self.vocabulary)
        return words, np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words)), np.concatenate(self.numbers)


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    """A task's rows (lang, text) as blocks of about most bytes, language by language."""
    parts: dict[str, _Part] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if text:
                parts.setdefault(lang, _Part()).add(text)
                size += len(text)
            if size >= most:
                yield from ((k, *p.whole(k)) for k, p in parts.items())
                parts, size = {}, 0
    yield from ((k, *p.whole(k)) for k, p in parts.items())


def places(hashes: np.ndarray, numbers: np.ndarray, fields: list[Field]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For phrases of 1, 2, ... words, one longer than there are fields: hash of the phrase at each place, and whether its shorter parts are candidates."""
    here, fine = hashes[numbers], numbers > 0
    yield here, fine
    for n, field in enumerate(fields, 2):
        fine = fine & field.has(here)
        fine = fine[:-1] & fine[1:]
        here = here[:-1] * STEP + hashes[numbers[n - 1 :]]
        yield here, fine


class _Tally:
    """Counts by hash of one language in a task, added up over its blocks of text."""

    def __init__(self) -> None:
        self.words, self.hashes, self.counts = 0, np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, words: int, hashes: np.ndarray) -> None:
        found, counts = np.unique(hashes, return_counts=True)
        both, where = np.unique(np.concatenate([self.hashes, found]), return_inverse=True)
        self.counts = np.bincount(where, np.concatenate([self.counts, counts]), len(both)).astype(np.int64)
        self.words, self.hashes = self.words + words, both


def reports(fields: list[Field], listed: dict[str, int], block: int, entries: int):
    """mapInArrow function: each shard's locally frequent phrases of the next length as (lang, hash, count beyond what may hide), and what may hide (no hash).

    A shard is what a task reads until it holds that many entries.
    """

    def told(lang: str, tally: _Tally) -> pa.RecordBatch:
        hidden = math.ceil(MIN_COUNT * tally.words / listed[lang]) - 1 if fields and tally.words and lang in listed else 0
        most = tally.counts > hidden
        h = pa.concat_arrays([pa.array(tally.hashes[most].view(np.int64)), pa.array([None], pa.int64())])
        c = pa.array(np.append(tally.counts[most] - hidden, hidden if fields else tally.words).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), h, c], ["lang", "h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, _Tally] = {}
        for lang, _, hashes, numbers in blocks(batches, block):
            *_, (here, fine) = places(hashes, numbers, fields)
            tallies.setdefault(lang, _Tally()).add(int((numbers > 0).sum()), here[fine])
            if sum(len(t.hashes) for t in tallies.values()) >= entries:
                yield from (told(*x) for x in tallies.items())
                tallies = {}
        yield from (told(*x) for x in tallies.items())

    return run


def counts(fields: list[Field], _: dict[str, int], block: int, entries: int):
    """mapInArrow function: exact counts of all candidates as (lang, phrase, a); a task sends what it has when that many entries are held, and at its end."""

    def told(lang: str, held: dict[bytes, int]) -> pa.RecordBatch:
        columns = [pa.array([lang] * len(held), pa.string()), pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, dict[bytes, int]] = {}
        for lang, words, hashes, numbers in blocks(batches, block):
            held = tallies.setdefault(lang, {})
            for n, (here, fine) in enumerate(places(hashes, numbers, fields[:-1]), 1):
                at = np.flatnonzero(fine & fields[n - 1].has(here))
                key = numbers[at].astype(np.int64)
                for j in range(1, n):  # numbers of the phrases, exact at each length
                    key = (np.unique(key, return_inverse=True)[1] if j > 1 else key) * len(words) + numbers[at + j]
                _, first, a = np.unique(key, return_index=True, return_counts=True)
                for p, count in zip(at[first].tolist(), a.tolist()):
                    phrase = b" ".join([words[w] for w in numbers[p : p + n].tolist()])
                    held[phrase] = held.get(phrase, 0) + count
            if sum(map(len, tallies.values())) >= entries:
                yield from (told(*x) for x in tallies.items())
                tallies = {}
        yield from (told(*x) for x in tallies.items())

    return run


def _field(hashes: DataFrame, n: int) -> Field:
    """The bit field of column h; of 2^FIELD_BITS bits at most, so what comes to the driver is bounded."""
    bits = min(FIELD_BITS, max(16, (16 * n).bit_length()))
    at = F.shiftrightunsigned("h", 64 - bits)
    rows = hashes.groupBy(F.shiftrightunsigned(at, 6).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("w")).toPandas()
    words = np.zeros(1 << bits >> 6, np.uint64)
    words[rows["i"].to_numpy()] = rows["w"].to_numpy().astype(np.int64).view(np.uint64)
    return Field(bits, words)


def counted_phrases(docs: DataFrame, scratch: Scratch, text: str = "text", lang: str = "lang", block: int = BLOCK_BYTES, entries: int = ENTRIES) -> tuple[DataFrame, DataFrame]:
    """Exact counts (lang, phrase, a) of all phrases of 1 to LONGEST words with at least MIN_COUNT, and (lang, n) of all words."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    fields: list[Field] = []
    listed: dict[str, int] = {}
    for n in range(1, LONGEST + 1):
        sent = spark.sparkContext.broadcast(fields)
        reported = rows.mapInArrow(_with(reports, sent, listed, block, entries), "lang string, h long, c long").groupBy("lang", "h").agg(F.sum("c").alias("c"))
        small = F.col("lang").isin(list(listed)) if listed else F.lit(False)
        united = scratch.written(reported.filter(F.col("h").isNull() | small | (F.col("c") >= MIN_COUNT)), f"united{n}")
        if n == 1:
            words = united.filter("h is null").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
            rows = rows.coalesce(max(2 * spark.sparkContext.defaultParallelism, words // TASK_WORDS))
            total = united.filter("h is null").select("lang", F.col("c").alias("n"))
            listed = {r.lang: r.n for r in total.filter((F.col("n") <= LARGE) & (F.col("n") >= MIN_COUNT)).orderBy(F.desc("n"), "lang").limit(LISTED).collect()}
            left = united.filter(F.col("h").isNotNull() & (F.col("c") >= MIN_COUNT))
        else:
            hidden = united.filter("h is null").select("lang", F.col("c").alias("hidden"))
            left = united.filter("h is not null").join(hidden, "lang").filter(F.col("c") >= MIN_COUNT - F.col("hidden"))
        fields = [*fields, _field(left, left.count())]
    sent = spark.sparkContext.broadcast(fields)
    exact = rows.mapInArrow(_with(counts, sent, listed, block, entries // 4), "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    return scratch.written(exact.filter(F.col("a") >= MIN_COUNT), "counted"), total


def _with(make, sent, listed: dict[str, int], block: int, entries: int):
    return lambda batches: make(sent.value, listed, block, entries)(batches)


def _words(first: Column, n: Column) -> Column:
    return F.array_join(F.slice("words", first, n), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, block: int = BLOCK_BYTES, entries: int = ENTRIES) -> DataFrame:
    """Each language's first phrases by score: lang, rank, phrase, a, l, r, n, score.

    A cut of a phrase scores floor(2000000 a / (l + r)), l and r being the counts of its parts; the lowest cut counts, of
    equal ones the one after the fewest words. A phrase goes where a longer one that holds it has WITHIN percent of its count.
    """
    counted, total = counted_phrases(docs, Scratch(docs.sparkSession, "phrases"), text, lang, block, entries)
    split = counted.withColumn("words", F.split("phrase", " ")).withColumn("size", F.size("words")).filter("size > 1")
    cuts = split.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    parts = cuts.select("lang", "phrase", "a", "k", _words(F.lit(1), F.col("k")).alias("first"), _words(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    of = lambda part, count: counted.select("lang", F.col("phrase").alias(part), F.col("a").alias(count))
    scored = parts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    scored = scored.withColumn("score", F.expr("(2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    inner = split.filter("size > 2").select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "a", "words", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("from"))
    held = inner.groupBy("lang", _words(F.col("from"), F.col("m")).alias("phrase")).agg(F.max("a").alias("most"))
    kept = best.join(held, ["lang", "phrase"], "left").filter(F.col("most").isNull() | F.expr(f"100 * cast(most as decimal(20, 0)) < {WITHIN} * cast(a as decimal(20, 0))"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = kept.withColumn("rank", rank).filter(F.col("rank") <= top)
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

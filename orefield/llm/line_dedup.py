r"""Repeated lines, found with levelled sorted runs of line hashes.

Documents come in batches, those with the largest ids first. A batch's line hashes are merge-anti-joined with the
runs written so far: what is left is seen for the first time, so this batch holds the copy that stays. Then the
batch adds its own sorted run of (hash, number of documents). When a level has FAN_IN runs, they are merged into
one run of the next level, so every hash is rewritten once per level. Only built-in functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, fresh, strip_blanks

N_BATCHES, FAN_IN = 4, 2
#: Keys drawn at random, between which the batches are cut; where the cuts lie changes no result.
DRAWN = 4096
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(strip_blanks(line))


def hashed(key: Column) -> tuple[Column, Column]:
    """128 bits in two longs; the second hash starts from another seed, so it is independent of the first."""
    return F.xxhash64(key), F.xxhash64(F.lit(7), key)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The sorted runs, by level. Each is a table of h1, h2, n, partitioned and sorted by the hash."""

    def __init__(self, scratch: Scratch, fan_in: int = FAN_IN):
        self.scratch, self.fan_in, self.levels = scratch, fan_in, [[]]

    def all(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        return reduce(DataFrame.unionByName, runs) if runs else None

    def write(self, counts: DataFrame, name: str) -> DataFrame:
        return self.scratch.written(counts.sortWithinPartitions(*HASH), name)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (h1, h2, ...) that no run holds."""
        runs = self.all()
        return keys if runs is None else keys.hint("merge").join(runs.select(*HASH), HASH, "left_anti")

    def add(self, run: DataFrame) -> None:
        """Take a run that write() has written, and merge levels that are full."""
        self.levels[0].append(run)
        for k, level in enumerate(self.levels):
            if len(level) >= self.fan_in:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self.merged(level, f"level{k + 1}"))
                for old in level:
                    self.scratch.drop(old)
                level.clear()

    def merged(self, runs: list[DataFrame], name: str) -> DataFrame:
        return self.write(reduce(DataFrame.unionByName, runs).groupBy(*HASH).agg(F.sum("n").alias("n")), name)


def batch_cuts(docs: DataFrame, key: str, n_batches: int) -> list:
    """Up to n_batches - 1 different keys, ascending, that deal the rows into batches of about one size; any type that can be ordered."""
    drawn = docs.select(F.col(key).alias("id")).filter("id is not null").orderBy(F.rand(11)).limit(DRAWN)
    keys = [r["id"] for r in drawn.orderBy("id").collect()]
    cuts = [keys[len(keys) * i // n_batches] for i in range(1, n_batches)] if keys else []
    return [x for i, x in enumerate(cuts) if i == 0 or x != cuts[i - 1]]


def repeated_lines(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_chars: int = 40, min_docs: int = 5, n_batches: int = N_BATCHES) -> tuple[DataFrame, DataFrame]:
    """(holds, frequent): which row (key, and a hash of its text) holds which line hash, once each; and for hashes in min_docs rows or more the largest key."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    cuts = batch_cuts(docs, key, n_batches)
    # batch 0 has the largest keys, the last the smallest and those that are null
    batch = reduce(lambda c, b: c + F.coalesce(F.col("id") <= F.lit(b), F.lit(True)).cast("int"), cuts, F.lit(0))
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col(text)), line_key), lambda k: F.length(k) >= min_chars))
    h1, h2 = hashed(F.col("line"))
    holds = scratch.written(
        docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("of_text"), F.explode(keys).alias("line")).select("id", "of_text", batch.alias("batch"), h1.alias("h1"), h2.alias("h2")),
        "holds",
        partition_by="batch",
    )
    runs, first = LineRuns(scratch), []
    for b in range(len(cuts) + 1):
        of_batch = holds.filter(F.col("batch") == b).groupBy(*HASH).agg(F.count("*").alias("n"), F.max("id").alias("holder"))
        of_batch = scratch.written(of_batch.sortWithinPartitions(*HASH), f"run{b}")
        first.append(scratch.written(runs.unseen(of_batch.select(*HASH, "holder")), f"first{b}"))
        run = of_batch.select(*HASH, "n")
        run._written_at = of_batch._written_at
        runs.add(run)
    counts = runs.all().groupBy(*HASH).agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select(*HASH)
    frequent = reduce(DataFrame.unionByName, first).join(counts, HASH)
    return holds.select("id", "of_text", *HASH), scratch.written(frequent, "frequent")


def line_dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_chars: int = 40, min_docs: int = 5, n_batches: int = N_BATCHES) -> DataFrame:
    """docs with two more columns: kept_lines (array) and n_lines (before dropping).

    A line's key is the line without blanks at its ends, A-Z lower-cased. Lines whose key has min_chars code points
    or more and is found in min_docs rows or more go, except in the rows with the largest id that holds it. A null
    or empty text is one empty line. Each row counts as a document; a null id is smaller than any other. Keys are of any type that can be ordered. Two
    different keys with the same 128-bit hash count as one. Other columns stay, but for those called kept_lines or
    n_lines; an empty table stays empty; rows that repeat are documents of their own. Rows with one id (null included)
    lose the same lines; those of them with one text share a set of dropped hashes, so no set is larger than a text. In a row with d dropped keys the filter compares each
    line with d hashes, so time grows with lines times d.
    """
    drop_id, drop_text, dropped = (fresh(docs, c) for c in ("drop_id", "drop_text", "dropped"))
    holds, frequent = repeated_lines(docs, text=text, key=key, min_chars=min_chars, min_docs=min_docs, n_batches=n_batches)
    drops = (
        holds.join(frequent, HASH)
        .filter(~F.col("id").eqNullSafe(F.col("holder")))
        .groupBy(F.col("id").alias(drop_id), F.col("of_text").alias(drop_text))
        .agg(F.collect_set(F.struct(*HASH)).alias(dropped))
    )
    joined = docs.join(drops, (F.xxhash64(text) == F.col(drop_text)) & F.col(key).eqNullSafe(F.col(drop_id)), "left")
    lines = lines_of(F.col(text))

    def stays(line: Column) -> Column:
        k = line_key(line)
        h1, h2 = hashed(k)
        return (F.length(k) < min_chars) | ~F.array_contains(F.col(dropped), F.struct(h1.alias("h1"), h2.alias("h2")))

    kept = F.when(F.col(dropped).isNull(), lines).otherwise(F.filter(lines, stays))
    return joined.select(*[c for c in docs.columns if c.lower() not in ("kept_lines", "n_lines")], kept.alias("kept_lines"), F.size(lines).cast("long").alias("n_lines"))


def without_repeated_lines(docs: DataFrame, *, text: str = "text", **options) -> tuple[DataFrame, Column]:
    """docs without their repeated lines, each row with its columns, and whether the row has lost lines; see line_dedup."""
    clash = {c: fresh(docs, f"{c}_given") for c in docs.columns if c.lower() in ("kept_lines", "n_lines")}
    out = line_dedup(docs.withColumnsRenamed(clash), text=text, **options)
    lines, lost = fresh(out, "lines_left"), fresh(out, "lost_lines")
    out = out.withColumn(lost, F.size("kept_lines") < F.col("n_lines")).withColumnRenamed("kept_lines", lines).drop("n_lines")
    out = out.withColumnsRenamed({v: k for k, v in clash.items()})
    return out.withColumn(text, F.when(F.col(lost), F.array_join(lines, "\n")).otherwise(F.col(text))), F.col(lost)

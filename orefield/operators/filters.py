"""Projections and filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rename_keep(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns of the map that exist, under their new names."""
    return df.select([F.col(a).alias(b) for a, b in names.items() if a in df.columns])


def coerce(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns; what can't be cast becomes null."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS {t})") for c, t in types.items() if c in df.columns})


def first_failing(rules: Sequence[tuple[str, Column, str]]) -> Column:
    """Number of the first rule (name, what must hold, why) that a row fails, from 1; null for rows that pass."""
    return F.coalesce(*[F.when(~F.coalesce(keep, F.lit(False)), F.lit(i)) for i, (_, keep, _) in enumerate(rules, 1)])


def audited_filter(df: DataFrame, rules: Sequence[tuple[str, Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(survivors, audit): rows that pass all rules in turn, and per rule how many it dropped, what remained and why.

    One pass marks each row with the first rule it fails; the audit is one aggregate of as many rows as there are rules.
    """
    marked = df.withColumn("_rule", first_failing(rules))
    kept = marked.filter("_rule IS NULL").drop("_rule")
    rows = [F.struct(F.lit(i).alias("step"), F.lit(n).alias("rule"), F.lit(w).alias("why")) for i, (n, _, w) in enumerate(rules, 1)]
    named = df.sparkSession.range(1).select(F.inline(F.array(*rows)))
    counts = marked.groupBy("_rule").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # a row for each rule
    dropped = F.coalesce("n", F.lit(0))
    audit = (
        named.join(counts, F.col("step") == F.col("_rule"), "left").crossJoin(F.broadcast(total))
        .select("step", "rule", "why", dropped.alias("dropped"), (F.col("total") - F.sum(dropped).over(upto)).alias("remaining"), F.round(100 * dropped / F.col("total"), 4).alias("pct"))
    )
    return kept, audit


def clip(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """(clipped, ledger): columns held to their bounds, and how many values of each that changed."""
    held = df.withColumns({c: F.greatest(F.least(F.col(c), F.lit(hi)), F.lit(lo)) for c, (lo, hi) in bounds.items()})
    counts = df.agg(*[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in bounds.items()])
    return held, unpivoted(counts, list(bounds), "column", "changed")


def unpivoted(one: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns])))


def in_box(lat: str, lon: str, box: tuple[float, float, float, float]) -> Column:
    return F.col(lat).between(box[0], box[1]) & F.col(lon).between(box[2], box[3])


def any_token(col: str, tokens: Sequence[str]) -> Column:
    """Whether the text holds one of the tokens, taken literally."""
    return reduce(lambda a, b: a | b, [F.contains(F.col(col), F.lit(t)) for t in tokens])


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order given, which should be total."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def search_score(query: str, title: str, notes: str, tags: str) -> Column:
    """3 to 2 by the place in the title, else 2 in the notes, else 1 in a tag; null where it is nowhere."""
    at, q = F.instr(F.lower(F.col(title)), query.lower()), F.lit(query.lower())
    return F.coalesce(F.when(at > 0, 3 - (at - 1) / 1000.0), F.when(F.contains(F.lower(F.col(notes)), q), 2.0), F.when(F.exists(F.col(tags), lambda t: F.contains(F.lower(t), q)), 1.0))


def valid(domains: Mapping[str, Sequence], ranges: Mapping[str, tuple]) -> Column:
    """Whether each column has one of its known values and lies in its half-open range [from, to); null is false."""
    known = [F.col(c).isin(list(v)) for c, v in domains.items()] + [(F.col(c) >= lo) & (F.col(c) < hi) for c, (lo, hi) in ranges.items()]
    return F.coalesce(reduce(lambda a, b: a & b, known, F.lit(True)), F.lit(False))

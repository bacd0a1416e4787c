"""Cohorts, RFM, funnels, time series, root causes, KPIs and the change log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNITS = {"day": "day", "week": "week", "month": "month"}


def period(ts: Column, grain: str) -> Column:
    """Start of the period as a date. Weeks end on Monday, so they begin on Tuesday."""
    if grain == "week":
        return F.date_add(F.date_trunc("week", F.date_sub(F.to_date(ts), 1)).cast("date"), 1)
    return F.date_trunc(UNITS[grain], ts).cast("date")


def periods_between(a: Column, b: Column, grain: str) -> Column:
    if grain == "month":
        return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    return (F.datediff(b, a) / (7 if grain == "week" else 1)).cast("int")


def cohort_table(activity: DataFrame, user: str, ts: str, grain: str = "month", started: Column | None = None) -> DataFrame:
    """user, cohort, active, period_number, one row each; activity before the cohort's start is left out.

    started marks the rows that may begin a cohort (feature adoption); by default any row does.
    """
    mark = F.when(started, F.col(ts)) if started is not None else F.col(ts)
    first = activity.groupBy(user).agg(F.min(mark).alias("_first")).filter("_first IS NOT NULL")
    joined = activity.join(first, user).filter(F.col(ts) >= F.col("_first"))
    rows = joined.select(user, period(F.col("_first"), grain).alias("cohort"), period(F.col(ts), grain).alias("active")).distinct()
    return rows.withColumn("period_number", periods_between(F.col("cohort"), F.col("active"), grain))


def retention(table: DataFrame, user: str) -> DataFrame:
    """cohort, period_number, users, size, rate."""
    counts = table.groupBy("cohort", "period_number").agg(F.count_distinct(user).alias("users"))
    sizes = table.groupBy("cohort").agg(F.count_distinct(user).alias("size"))
    return counts.join(sizes, "cohort").withColumn("rate", F.col("users") / F.col("size"))


def rfm(orders: DataFrame, user: str, ts: str, order: str, value: str) -> DataFrame:
    """Recency in days before the day after the last order, number of orders, and value."""
    end = orders.agg(F.date_add(F.max(ts).cast("date"), 1).alias("_end"))
    by = orders.groupBy(user).agg(F.max(ts).alias("_last"), F.count_distinct(order).alias("frequency"), F.sum(value).alias("monetary"))
    return by.crossJoin(F.broadcast(end)).select(user, F.datediff("_end", F.col("_last").cast("date")).alias("recency"), "frequency", "monetary")


def funnel(counts: DataFrame, steps: Sequence[str]) -> DataFrame:
    """From one row with a count per step: step, n, conversion from the step before and overall, drop-off."""
    long = counts.select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("step"), F.col(s).alias("n")) for i, s in enumerate(steps, 1)])), F.col(steps[0]).alias("_all"))
    before = F.lag("n").over(Window.orderBy("place"))  # a row for each step
    return long.select("place", "step", "n", F.when(before > 0, F.col("n") / before).alias("from_before"), F.when(F.col("_all") > 0, F.col("n") / F.col("_all")).alias("overall"), (before - F.col("n")).alias("dropped"))


def calendar(series: DataFrame, day: str, value: str) -> DataFrame:
    """The series with a row for each day from the first to the last, 0 where there was none."""
    spine = series.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.sequence("a", "b")).alias(day))
    return spine.join(series, day, "left").select(day, F.coalesce(value, F.lit(0.0)).alias(value))


def trend(series: DataFrame, order: str, value: str) -> DataFrame:
    """Slope per step, slope as percent of the mean, direction."""
    at = series.withColumn("_i", F.row_number().over(Window.orderBy(order)) - 1)
    one = at.agg(F.regr_slope(value, "_i").alias("slope"), F.avg(value).alias("mean"))
    pct = F.when(F.col("mean") != 0, 100 * F.col("slope") / F.col("mean"))
    return one.select("slope", pct.alias("pct"), F.when(F.abs(pct) < 0.1, "flat").when(F.col("slope") > 0, "up").otherwise("down").alias("direction"))


def spikes(series: DataFrame, order: str, value: str, z: float) -> DataFrame:
    stats = series.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    scored = series.crossJoin(F.broadcast(stats)).withColumn("z", (F.col(value) - F.col("_m")) / F.col("_s"))
    return scored.filter(F.abs("z") >= z).select(order, value, "z", F.when(F.col("z") > 0, "spike").otherwise("dip").alias("kind"))


def decompose(series: DataFrame, day: str, value: str, season: int = 7) -> DataFrame:
    """Trend (centred mean), seasonal (mean of what is left per phase, summing to 0) and rest. season is odd; ends have no trend."""
    half = season // 2
    w = Window.orderBy(day)
    at = series.withColumn("_i", F.row_number().over(w) - 1)
    full = F.count(value).over(w.rowsBetween(-half, half)) == season
    at = at.withColumn("trend", F.when(full, F.avg(value).over(w.rowsBetween(-half, half)))).withColumn("_phase", F.col("_i") % season)
    phases = at.groupBy("_phase").agg(F.avg(F.col(value) - F.col("trend")).alias("_p"))
    centre = phases.agg(F.avg("_p").alias("_c"))
    out = at.join(F.broadcast(phases), "_phase").crossJoin(F.broadcast(centre)).withColumn("seasonal", F.col("_p") - F.col("_c"))
    return out.select(day, value, "trend", "seasonal", (F.col(value) - F.col("trend") - F.col("seasonal")).alias("rest"))


def forecast_scores(series: DataFrame, day: str, value: str, holdout: int, season: int = 7) -> DataFrame:
    """MAPE (where the value isn't 0) and MAE of the seasonal-naive forecast on the last rows."""
    last = F.row_number().over(Window.orderBy(F.desc(day)))
    rows = series.select(F.col(value).alias("y"), F.lag(value, season).over(Window.orderBy(day)).alias("f"), last.alias("r")).filter(F.col("r") <= holdout)
    error = F.abs(F.col("y") - F.col("f"))
    return rows.agg(F.avg(F.when(F.col("y") != 0, 100 * error / F.abs("y"))).alias("mape"), F.avg(error).alias("mae"))


def drill_down(df: DataFrame, dimensions: Sequence[str], value: str, first: Column, second: Column) -> DataFrame:
    """dimension, level, before, after, change, share of the whole change: grouping sets of one scan, no join of periods."""
    both = df.select(*dimensions, F.when(first, F.col(value)).otherwise(0.0).alias("a"), F.when(second, F.col(value)).otherwise(0.0).alias("b"))
    long = both.select("a", "b", F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level")) for d in dimensions])))
    sums = long.groupBy("dimension", "level").agg(F.sum("a").alias("before"), F.sum("b").alias("after"))
    total = both.agg((F.sum("b") - F.sum("a")).alias("_t"))
    change = F.col("after") - F.col("before")
    return sums.crossJoin(F.broadcast(total)).select("dimension", "level", "before", "after", change.alias("change"), F.when(F.col("_t") != 0, 100 * change / F.col("_t")).alias("share"))


def revenue_bridge(payments: DataFrame, user: str, month: str, value: str) -> DataFrame:
    """Per month: new, expansion, contraction and churned revenue, and what it ends with. payments: one row per user and month."""
    by = payments.groupBy(user, month).agg(F.sum(value).alias("now"))
    nxt = by.select(user, F.add_months(month, 1).alias(month), F.col("now").alias("was"))
    both = by.join(nxt, [user, month], "full_outer").select(month, F.coalesce("now", F.lit(0.0)).alias("now"), F.coalesce("was", F.lit(0.0)).alias("was"))
    up, down = F.col("now") - F.col("was"), F.col("was") - F.col("now")
    return both.groupBy(month).agg(
        F.sum(F.when(F.col("was") == 0, F.col("now")).otherwise(0.0)).alias("new"), F.sum(F.when((F.col("was") > 0) & (up > 0), up).otherwise(0.0)).alias("expansion"),
        F.sum(F.when((F.col("now") > 0) & (down > 0), down).otherwise(0.0)).alias("contraction"), F.sum(F.when(F.col("now") == 0, F.col("was")).otherwise(0.0)).alias("churned"), F.sum("now").alias("ends"),
    )


def query_metric(df: DataFrame, metrics: Mapping[str, Column], dimensions: Sequence[str], grain: tuple[str, str] | None = None) -> DataFrame:
    """Named metrics by dimensions and, with grain (ts column, unit), by period."""
    keys = [F.col(d) for d in dimensions] + ([period(F.col(grain[0]), grain[1]).alias("period")] if grain else [])
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in metrics.items()])


def folded(changes: DataFrame, key: str, seq: str, columns: Sequence[str], deleted: str = "deleted") -> DataFrame:
    """Latest state per key of a change log: each column's last value that isn't null; keys whose last change deletes are left out.

    Aggregates that combine before the shuffle, so a key with many changes is no hot group.
    """
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns]
    return changes.groupBy(key).agg(*last, F.max(seq).alias(seq), F.max_by(F.coalesce(deleted, F.lit(False)), seq).alias("_gone")).filter("NOT _gone").drop("_gone")


def cascade(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return children.join(gone.select(key).distinct(), key, "left_anti")


def reconcile(a: DataFrame, b: DataFrame, on: Sequence[str], left: str, right: str) -> DataFrame:
    """Both measures by key, a missing side as 0, and their difference."""
    both = a.join(b, list(on), "full_outer").na.fill(0.0, [left, right])
    return both.withColumn("difference", F.col(left) - F.col(right))


def segment_index(df: DataFrame, segment: str, value: str) -> DataFrame:
    """Per segment: n, mean, index against the population (100), z of the mean, and over or under at 20 %."""
    whole = df.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    by = df.groupBy(segment).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).crossJoin(F.broadcast(whole))
    index = 100 * F.col("mean") / F.col("_m")
    return by.select(segment, "n", "mean", index.alias("index"), ((F.col("mean") - F.col("_m")) / F.col("_s")).alias("z"), F.when(index >= 120, "over").when(index <= 80, "under").otherwise("even").alias("label"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def soft_state(events: DataFrame, key: str, order: Sequence[str], kind: str, deleted: Sequence[str], restored: Sequence[str], done: Sequence[str], reopened: Sequence[str]) -> DataFrame:
    """key, deleted, done: folded from change events, the last of each sort deciding. A row stays in the log when it is deleted."""
    at = F.struct(*order)

    def last(on, off):
        return F.coalesce(F.max_by(F.col(kind).isin(list(on)), F.when(F.col(kind).isin([*on, *off]), at)), F.lit(False))

    return events.groupBy(key).agg(last(deleted, restored).alias("deleted"), last(done, reopened).alias("done"))


def clear_completed(state: DataFrame) -> DataFrame:
    """State with what is done deleted too; cleared marks what this deleted."""
    return state.withColumn("cleared", F.col("done") & ~F.col("deleted")).withColumn("deleted", F.col("deleted") | F.col("done"))

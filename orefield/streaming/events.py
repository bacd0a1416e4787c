"""Event-time operators. Each takes a stream or a table: a watermark means nothing to a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

LATE = "10 minutes"


def read_events(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there, into Parquet."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def tumbling(events: DataFrame, ts: str, width: str, keys: Sequence[str], value: str, late: str = LATE) -> DataFrame:
    """start, keys, n, total."""
    by = events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return by.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, ts: str, width: str, slide: str, value: str, late: str = LATE) -> DataFrame:
    by = events.withWatermark(ts, late).groupBy(F.window(ts, width, slide)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return by.select(F.col("window.start").alias("start"), "n", "mean")


def sessions(events: DataFrame, ts: str, user: str, gap: str, late: str = LATE) -> DataFrame:
    by = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n"))
    return by.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, ts: str, key: str, late: str = LATE) -> DataFrame:
    """Each key once; in a stream within the watermark."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def counters(events: DataFrame, user: str, marks: dict[str, Column]) -> DataFrame:
    """Running counts per user (update mode in a stream)."""
    return events.groupBy(user).agg(F.count("*").alias("n"), *[F.count_if(c).alias(m) for m, c in marks.items()])


def enriched(events: DataFrame, dimension: DataFrame, on: Sequence[str]) -> DataFrame:
    return events.join(dimension, list(on), "left")


def followed_by(first: DataFrame, then: DataFrame, user: str, ts: str, within: str, late: str = LATE) -> DataFrame:
    """user, at, then_at of every pair in which then comes at or after first and within the interval. Both are watermarked, so a stream can forget."""
    a = first.select(F.col(user), F.col(ts).alias("at")).withWatermark("at", late)
    b = then.select(F.col(user).alias("_u"), F.col(ts).alias("then_at")).withWatermark("then_at", late)
    return a.join(b, (F.col(user) == F.col("_u")) & (F.col("then_at") >= F.col("at")) & (F.col("then_at") <= F.col("at") + F.expr(f"INTERVAL {within}"))).select(user, "at", "then_at")


def split_late(events: DataFrame, ts: str, arrival: str, bound: str) -> tuple[DataFrame, DataFrame]:
    """(in time, late): by how long after its time an event arrives."""
    late = F.col(arrival) - F.col(ts) > F.expr(f"INTERVAL {bound}")
    return events.filter(~late), events.filter(late)


def flagged(windows: DataFrame, baseline: DataFrame, keys: Sequence[str], value: str, z: float) -> DataFrame:
    """Windows whose value lies z deviations or more from the baseline (keys, mean, sd)."""
    joined = windows.join(baseline, list(keys))
    return joined.withColumn("z", (F.col(value) - F.col("mean")) / F.col("sd")).filter(F.abs("z") >= z)


class Versions:
    """A table kept as one version for each epoch of a stream, in a shared folder; of those before the last two nothing is kept."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        self.spark, self.path, self.schema = spark, path, schema

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def epochs(self) -> list[int]:
        """Epochs whose version is whole."""
        path, files = self._folder()
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        whole = lambda n: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        return sorted(int(n.removeprefix("epoch-")) for n in names if n.startswith("epoch-") and whole(n))

    def before(self, epoch: int | None = None) -> DataFrame | None:
        """The newest version of an epoch before that one; of all without one."""
        known = [e for e in self.epochs() if epoch is None or e < epoch]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/epoch-{known[-1]}") if known else None

    def write(self, table: DataFrame, epoch: int) -> None:
        table.write.mode("overwrite").parquet(f"{self.path}/epoch-{epoch}")
        path, files = self._folder()
        for old in [e for e in self.epochs() if e < epoch][:-1]:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/epoch-{old}"), True)


def upsert_batches(changes: DataFrame, fold: Callable[[DataFrame], DataFrame], state: Versions, checkpoint: str) -> StreamingQuery:
    """Keep a latest-state table: each micro-batch is folded with the version before its epoch and written as that epoch's.

    A batch that is run again after a failure starts from the same version as before and overwrites its own, so nothing is folded in twice.
    """
    def step(batch: DataFrame, epoch: int) -> None:
        before = state.before(epoch)
        state.write(fold(batch if before is None else before.unionByName(batch, allowMissingColumns=True)), epoch)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counters(events: DataFrame, user: str, mark: Column, path: str, checkpoint: str) -> StreamingQuery:
    """Per user and micro-batch with events of theirs: n and marked since the stream began, from state that Spark keeps by user.

    The state is two numbers a user. Each epoch's rows go into a folder of its own, which a repeated batch overwrites.
    """
    counted = events.select(F.col(user).alias("user"), F.coalesce(mark, F.lit(False)).alias("marked"))

    def add(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, marked = state.get if state.exists else (0, 0)
        for frame in frames:
            n, marked = n + len(frame), marked + int(frame["marked"].sum())
        state.update((n, marked))
        yield pd.DataFrame({"user": [key[0]], "n": [n], "marked": [marked]})

    kind = events.schema[user].dataType.simpleString()
    rows = counted.groupBy("user").applyInPandasWithState(add, f"user {kind}, n long, marked long", "n long, marked long", "update", GroupStateTimeout.NoTimeout)
    step = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return rows.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counters(spark: SparkSession, path: str, user_type: str) -> DataFrame:
    """user, n, marked after all epochs that running_counters has written."""
    rows = spark.read.schema(f"user {user_type}, n long, marked long, epoch long").parquet(path)
    return rows.groupBy("user").agg(F.max("n").alias("n"), F.max("marked").alias("marked"))

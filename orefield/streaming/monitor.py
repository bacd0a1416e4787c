"""Per-batch drift and scoring of a stream."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.evaluation import bin_counts, mean_drift, population_stability, quantile_cuts, stability
from ..sources.shared import written


def drift_report(reference: DataFrame, batch: DataFrame, columns: Sequence[str], limit: float = 0.25) -> DataFrame:
    """column, psi, z of the mean, verdict."""
    both = population_stability(reference, batch, columns).join(mean_drift(reference, batch, columns), "column")
    return both.withColumn("verdict", F.when(F.col("psi") > limit, "drift").otherwise("stable"))


@dataclass(frozen=True)
class Reference:
    """What a stream is compared with, frozen in written tables: quantile cuts (one row), bin counts, and mean and deviation by column."""

    columns: tuple[str, ...]
    cuts: DataFrame
    counts: DataFrame
    moments: DataFrame

    @classmethod
    def of(cls, table: DataFrame, columns: Sequence[str]) -> Reference:
        cuts = written(quantile_cuts(table, columns), "cuts")
        each = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns]))
        moments = table.select(each).groupBy("column").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
        return cls(tuple(columns), cuts, written(bin_counts(table, cuts, columns), "bins"), written(moments, "moments"))


def watch(stream: DataFrame, reference: Reference, path: str, checkpoint: str) -> StreamingQuery:
    """Bin counts and sums of each micro-batch, in a folder of its epoch.

    A batch that is run again after a failure overwrites its own folder, so each counts once.
    """
    columns = reference.columns
    at = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns]))

    def step(batch: DataFrame, epoch: int) -> None:
        sums = batch.select(at).groupBy("column").agg(F.count("x").alias("n"), F.sum("x").alias("total"))
        bins = bin_counts(batch, reference.cuts, columns).select("column", "bin", "n", F.lit(None).cast("double").alias("total"))
        bins.unionByName(sums.select("column", F.lit(-1).alias("bin"), "n", "total")).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drift_so_far(spark: SparkSession, path: str, reference: Reference, limit: float = 0.25) -> DataFrame:
    """column, n, psi, z of the mean, verdict, over all epochs that watch has written."""
    all_bins = spark.read.schema("column string, bin int, n long, total double, epoch long").parquet(path).groupBy("column", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    psi = stability(reference.counts, all_bins.filter("bin >= 0").select("column", "bin", "n"))
    means = all_bins.filter("bin = -1").join(reference.moments, "column")
    z = F.try_divide(F.col("total") / F.col("n") - F.col("mean"), F.col("sd"))
    return means.join(psi, "column").select("column", "n", "psi", z.alias("z"), F.when(F.col("psi") > limit, "drift").otherwise("stable").alias("verdict"))


def scored(stream: DataFrame, model: Model, version: str) -> DataFrame:
    """Stream or table with the model's prediction and its version."""
    return model.transform(stream).withColumn("model_version", F.lit(version))

"""Streams that are stopped and started again: drift, latest state and counters, each batch counted once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import business as B
from ..sources.shared import new_folder
from ..streaming import events as T
from ..streaming import monitor
from .base import Registry, Tables
from .modelling import _PSI, rounded

query = Registry()
QUERIES, SQL = query.queries, query.sql
DRIFT = ["l_quantity", "l_extendedprice"]


def in_two_runs(df: DataFrame, half: str, folder: str, start: Callable[[DataFrame], object]) -> None:
    """The rows arrive in files; a stream reads those where half holds, stops, and goes on from its checkpoint with the rest."""
    for arrived in (f"{half}", f"NOT ({half})"):
        df.filter(arrived).repartition(2).write.mode("append").parquet(folder)
        start(T.read_events(df.sparkSession, folder, df.schema)).awaitTermination()


@query(f"""WITH psi AS ({' UNION ALL '.join('SELECT * FROM (WITH ' + _PSI.format(c=c) + ')' for c in DRIFT)}),
    z AS ({' UNION ALL '.join(f'''SELECT '{c}' AS "column", (SELECT count({c}) FROM lineitem WHERE l_orderkey % 2 = 1) AS n, round(((SELECT avg({c}) FROM lineitem WHERE l_orderkey % 2 = 1) - avg({c})) / stddev_samp({c}), 8) AS z FROM lineitem WHERE l_orderkey % 2 = 0''' for c in DRIFT)})
    SELECT "column", n, psi, z, CASE WHEN psi > 0.25 THEN 'drift' ELSE 'stable' END AS verdict FROM psi JOIN z USING ("column")""")
def t8_drift_monitor(t: Tables) -> DataFrame:
    """Half of the lines as a stream against the other half, frozen; two runs with one checkpoint."""
    base = new_folder(t.spark, "t8")
    reference = monitor.Reference.of(t.lineitem.filter("l_orderkey % 2 = 0"), DRIFT)
    rows = t.lineitem.filter("l_orderkey % 2 = 1").select("l_orderkey", *DRIFT)
    in_two_runs(rows, "l_orderkey % 4 = 1", f"{base}/rows", lambda s: monitor.watch(s, reference, f"{base}/epochs", f"{base}/checkpoint"))
    return rounded(monitor.drift_so_far(t.spark, f"{base}/epochs", reference))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def t5_streamed_state(t: Tables) -> DataFrame:
    """The latest event of each user as a table that a stream of changes keeps, in versions."""
    base = new_folder(t.spark, "t5")
    log = t.events.select("user_id", "event_id", "event_type", "value", F.lit(False).alias("deleted"))
    fold = lambda df: B.folded(df, "user_id", "event_id", ["event_type", "value"]).withColumn("deleted", F.lit(False))
    state = T.Versions(t.spark, f"{base}/state", "user_id long, event_type string, value double, event_id long, deleted boolean")
    in_two_runs(log, "event_id % 3 = 0", f"{base}/log", lambda s: T.upsert_batches(s, fold, state, f"{base}/checkpoint"))
    return state.before().drop("deleted")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS bought FROM events GROUP BY 1")
def t6_running_counters(t: Tables) -> DataFrame:
    """Counters that a stream keeps as state by user; two runs with one checkpoint."""
    base = new_folder(t.spark, "t6")
    rows = t.events.select("event_id", "user_id", "event_type")
    in_two_runs(rows, "event_id % 3 = 0", f"{base}/log", lambda s: T.running_counters(s, "user_id", F.col("event_type") == "purchase", f"{base}/epochs", f"{base}/checkpoint"))
    out = T.latest_counters(t.spark, f"{base}/epochs", rows.schema["user_id"].dataType.simpleString())
    return out.select(F.col("user").alias("user_id"), "n", F.col("marked").alias("bought"))

"""Event-time operators over the events table (their batch form) and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import business as B
from ..operators import text as K
from ..sources import tables as S
from ..streaming import events as T
from .base import Registry, Tables

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t1_tumbling(t: Tables) -> DataFrame:
    return T.tumbling(t.events, "ts", "1 hour", ["event_type"], "value").withColumn("total", F.round("total", 4))


@query("SELECT date_trunc('hour', ts) - to_hours(h) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events, range(24) r(h) GROUP BY 1")
def t2_sliding(t: Tables) -> DataFrame:
    return T.sliding(t.events, "ts", "1 day", "1 hour", "value").withColumn("mean", F.round("mean", 6))


@query("""WITH g AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER w >= INTERVAL 6 HOUR)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def t3_sessions(t: Tables) -> DataFrame:
    return T.sessions(t.events, "ts", "user_id", "6 hours")


@query("SELECT event_id, ts FROM events")
def t4_once(t: Tables) -> DataFrame:
    twice = t.events.select("event_id", "ts").unionByName(t.events.filter("user_id % 2 = 0").select("event_id", "ts"))
    return T.once(twice, "ts", "event_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def t5_latest_state(t: Tables) -> DataFrame:
    log = t.events.select("user_id", "event_id", "event_type", "value").withColumn("deleted", F.lit(False))
    return B.folded(log, "user_id", "event_id", ["event_type", "value"])


@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS bought FROM events GROUP BY 1")
def t6_counters(t: Tables) -> DataFrame:
    return T.counters(t.events, "user_id", {"bought": F.col("event_type") == "purchase"})


@query("SELECT count(*) AS late FROM events WHERE event_id % 60 > 45")
def t7_late(t: Tables) -> DataFrame:
    arrived = t.events.withColumn("arrival", F.expr("ts + make_interval(0, 0, 0, 0, 0, event_id % 60)"))
    return T.split_late(arrived, "ts", "arrival", "45 MINUTES")[1].agg(F.count("*").alias("late"))


@query("SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey")
def t10_enriched(t: Tables) -> DataFrame:
    return T.enriched(t.events, t.customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment"), ["user_id"]).select("event_id", "c_mktsegment")


@query("SELECT a.user_id, a.ts AS at, b.ts AS then_at FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 3 HOUR WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def t11_followed_by(t: Tables) -> DataFrame:
    kind = lambda k: t.events.filter(F.col("event_type") == k)
    return T.followed_by(kind("view"), kind("purchase"), "user_id", "ts", "3 HOURS")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT event_type, avg(n) AS mean, stddev_samp(n) AS sd FROM w GROUP BY 1) SELECT start, event_type, n, round((n - mean) / sd, 8) AS z FROM w JOIN b USING (event_type) WHERE abs((n - mean) / sd) >= 2""")
def t12_flagged(t: Tables) -> DataFrame:
    w = T.tumbling(t.events, "ts", "1 hour", ["event_type"], "value").select("start", "event_type", "n")
    base = w.groupBy("event_type").agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"))
    return T.flagged(w, base, ["event_type"], "n", 2.0).select("start", "event_type", "n", F.round("z", 8).alias("z"))


@query("SELECT count(*) AS rows FROM lineitem")
def s3_read_by_suffix(t: Tables) -> DataFrame:
    return S.read_table(t.spark, f"{t.sf_dir}/lineitem.parquet").agg(F.count("*").alias("rows"))


@query("SELECT l_returnflag, 'quantity' AS key, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'lines', count(*) FROM lineitem GROUP BY 1")
def s10_melted(t: Tables) -> DataFrame:
    wide = t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count("*").alias("lines"))
    return S.melted(wide, ["l_returnflag"], ["quantity", "lines"])


@query()
def s14_content_hash(t: Tables) -> DataFrame:
    return S.content_hash(t.orders)


@query(r"SELECT item_id AS doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS tokens FROM benchmark")
def s11_token_arrays(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("doc_id"), K.words(F.col("text")).alias("tokens"))

"""Further operators of the inventory: joins of itemsets, basket steps, trials, features, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import measured
from ..operators import aggregates as A
from ..operators import business as B
from ..operators import evaluation as E
from ..operators import mlfeatures as M
from ..operators import patterns as P
from ..operators import quality as Q
from ..operators.blocks import nearest
from ..operators.quantiles import quantiles
from .base import Registry, Tables
from .mining import _RULES, _SETS, SUPPORT, baskets, pair_rules, shown

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("SELECT doc_id FROM documents WHERE length(trim(text)) >= 2000")
def s5_min_length(t: Tables) -> DataFrame:
    return t.documents.filter(F.length(F.trim("text")) >= 2000).select("doc_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 0 UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 1")
def s4_shards(t: Tables) -> DataFrame:
    part = lambda h: t.lineitem.filter(F.col("l_orderkey") % 2 == h).select("l_orderkey", "l_linenumber")
    return B.union_all([part(0), part(1)])


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def s7_sql_scan(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY 1", orders=t.orders)


@query(f"WITH {_SETS} SELECT a.items[1] AS x, a.items[2] AS y, b.items[2] AS z FROM sets a JOIN sets b ON len(a.items) = 2 AND len(b.items) = 2 AND a.items[1] = b.items[1] AND a.items[2] < b.items[2]")
def j9_prefix_join(t: Tables) -> DataFrame:
    pairs = P.eclat(baskets(t), SUPPORT, 2).filter("size(items) = 2").select(F.col("items")[0].alias("x"), F.col("items")[1].alias("y"))
    return pairs.join(pairs.withColumnRenamed("y", "z"), "x").filter("y < z")


@query("WITH b AS (SELECT DISTINCT l_suppkey AS s, l_orderkey AS k FROM lineitem) SELECT x.s AS a, y.s AS b, count(*) AS both FROM b x JOIN b y ON x.k = y.k AND x.s < y.s GROUP BY 1, 2")
def j16_tid_intersection(t: Tables) -> DataFrame:
    return P.tid_intersections(t.lineitem.select("l_suppkey", "l_orderkey"), "l_suppkey", "l_orderkey")


@query("WITH c AS (SELECT a.vec_id AS q, b.vec_id AS n, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 8) AS d FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) SELECT q, n, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, n) AS place FROM c) WHERE place <= 2")
def j17_nearest(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    rows = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    asked = rows.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("w"))
    near = nearest(rows, asked, 2, "distance", other_only=True)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("score"), "doc_id"))
    return near.withColumn("place", place).filter("place <= 2").select(F.col("query_id").alias("q"), F.col("doc_id").alias("n"), "place")


@query("SELECT o_orderpriority, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS \"F\", round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS \"O\", round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O') - sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS delta FROM orders GROUP BY 1")
def a10_pivot_delta(t: Tables) -> DataFrame:
    wide = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).sum("o_totalprice")
    return wide.select("o_orderpriority", F.round("F", 2).alias("F"), F.round("O", 2).alias("O"), F.round(F.col("O") - F.col("F"), 2).alias("delta"))


@query("SELECT column_name AS \"column\", n AS non_null, d AS \"distinct\" FROM (SELECT 'c_custkey' AS column_name, count(c_custkey) AS n, count(DISTINCT c_custkey) AS d FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), count(DISTINCT c_mktsegment) FROM customer)")
def a26_overview(t: Tables) -> DataFrame:
    return Q.dictionary(t.customer.select("c_custkey", "c_mktsegment"), "customer").select("column", "non_null", "distinct")


@query(f"WITH {_RULES} SELECT a, c, round(n11 / n1, 8) AS confidence FROM r WHERE n11 / n1 >= 0.12 AND n11 * n / (n1 * m1) >= 0.95")
def p10_thresholds(t: Tables) -> DataFrame:
    table = measured(pair_rules(t), ["confidence", "lift"])
    return shown(table.filter("confidence >= 0.12 AND lift >= 0.95"), F.round("confidence", 8).alias("confidence"))


@query(f"WITH {_SETS}, h AS (SELECT k, list(i) AS l FROM b WHERE k % 2 = 1 GROUP BY k) SELECT array_to_string(items, ',') AS items, (SELECT count(*) FROM h WHERE list_has_all(l, s.items)) AS n FROM (SELECT * FROM sets WHERE len(items) = 2) s")
def p12_recount(t: Tables) -> DataFrame:
    pairs = P.eclat(baskets(t), SUPPORT, 2).filter("size(items) = 2")
    return P.recounted(pairs, baskets(t).filter("basket_id % 2 = 1"), "n").select(F.array_join("items", ",").alias("items"), "n")


@query(f"WITH {_RULES}, l AS (SELECT n11 * n / (n1 * m1) AS lift FROM r), e AS (SELECT quantile_cont(lift, [0.25, 0.5, 0.75]) AS e FROM l) SELECT len(list_filter(e, lambda x: x < lift))::INTEGER AS bin, count(*) AS rules, round(avg(lift), 8) AS lift FROM l, e GROUP BY 1")
def p17_lift_bins(t: Tables) -> DataFrame:
    table = measured(pair_rules(t), ["lift"]).select("lift")
    edges = table.agg(F.percentile("lift", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("e"))
    at = F.size(F.filter("e", lambda x: x < F.col("lift")))
    return table.crossJoin(F.broadcast(edges)).groupBy(at.alias("bin")).agg(F.count("*").alias("rules"), F.round(F.avg("lift"), 8).alias("lift"))


@query("SELECT 'c_acctbal' AS \"column\", round((SELECT avg((x - m) ** 3) / avg((x - m) ** 2) ** 1.5 FROM (SELECT c_acctbal AS x FROM customer), (SELECT avg(c_acctbal) AS m FROM customer)), 8) AS \"before\", round((SELECT avg((x - m) ** 3) / avg((x - m) ** 2) ** 1.5 FROM (SELECT ln(1 + greatest(c_acctbal, 0)) AS x FROM customer), (SELECT avg(ln(1 + greatest(c_acctbal, 0))) AS m FROM customer)), 8) AS \"after\"")
def c10_skew_effect(t: Tables) -> DataFrame:
    return M.skew_effect(t.customer, ["c_acctbal"]).select("column", F.round("before", 8).alias("before"), F.round("after", 8).alias("after"))


@query()
def c9_yeo_johnson(t: Tables) -> DataFrame:
    return M.yeo_johnson_lambda(t.events, "value", [x / 4 for x in range(-8, 9)])


@query("WITH c AS (SELECT o_orderpriority AS g, quantile_cont(o_totalprice - 250000, 0.1) AS lo, quantile_cont(o_totalprice - 250000, 0.9) AS hi FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT count(*) AS n, round(avg((o_totalprice - 250000 BETWEEN lo AND hi)::INT), 8) AS covered FROM orders JOIN c ON g = o_orderpriority WHERE o_orderkey % 2 = 1")
def c40_interval_coverage(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("p", F.lit(250_000.0))
    bounds = M.conformal(rows.filter("o_orderkey % 2 = 0"), "o_totalprice", "p", "o_orderpriority", 0.1, 0.9)
    return M.coverage(rows.filter("o_orderkey % 2 = 1"), bounds, "o_totalprice", "p", "o_orderpriority").withColumn("covered", F.round("covered", 8))


@query("WITH m AS (SELECT quantile_cont(o_totalprice, 0.5) AS p FROM orders WHERE o_orderkey % 5 <> 0) SELECT round(avg(abs(o_totalprice - p)), 4) AS mae, round(sqrt(avg((o_totalprice - p) ** 2)), 4) AS rmse FROM orders, m WHERE o_orderkey % 5 = 0")
def c41_median_baseline(t: Tables) -> DataFrame:
    median = quantiles(t.orders.filter("o_orderkey % 5 <> 0"), "o_totalprice", [0.5]).select(F.col("quantiles")[0].alias("p"))
    held = t.orders.filter("o_orderkey % 5 = 0").crossJoin(F.broadcast(median))
    return E.regression_scores(held, "o_totalprice", "p").select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@query("SELECT l_returnflag, 'bulk' AS flag, count(*) AS n, count(*) FILTER (WHERE l_quantity > 45) AS flagged FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'free', count(*), count(*) FILTER (WHERE l_discount > 0.09) FROM lineitem GROUP BY 1")
def c55_flags(t: Tables) -> DataFrame:
    return M.flags_by_cohort(t.lineitem, "l_returnflag", {"bulk": F.col("l_quantity") > 45, "free": F.col("l_discount") > 0.09}).select("l_returnflag", "flag", "n", "flagged")


@query("SELECT user_id, arg_max(h, (s, h))::INTEGER AS peak, round(max(s), 4) AS score FROM (SELECT user_id, hour(ts) AS h, round(sum(value), 4) AS s FROM events GROUP BY 1, 2) GROUP BY 1")
def c53_peak_hour(t: Tables) -> DataFrame:
    by = t.events.groupBy("user_id", F.hour("ts").alias("hour")).agg(F.round(F.sum("value"), 4).alias("s"))
    return M.peak(by, "user_id", "hour", "s").withColumn("score", F.round("score", 4))


@query("WITH c AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m FROM customer GROUP BY 1) SELECT c_mktsegment, n > 100 AS ok_size, m > 4500 AS ok_balance, ((NOT n > 100)::INT + (NOT m > 4500)::INT) AS n_failed FROM c")
def c59_charter(t: Tables) -> DataFrame:
    by = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("m"))
    return M.charter(by, {"size": F.col("n") > 100, "balance": F.col("m") > 4500}).select("c_mktsegment", "ok_size", "ok_balance", "n_failed")


@query("SELECT o_orderpriority, o_orderstatus, round(max(o_totalprice), 2) AS best, count(*) AS n, row_number() OVER (ORDER BY max(o_totalprice) DESC, o_orderpriority, o_orderstatus)::INTEGER AS place FROM orders GROUP BY 1, 2")
def c50_leaderboard(t: Tables) -> DataFrame:
    return M.leaderboard(t.orders, ["o_orderpriority", "o_orderstatus"], "o_totalprice").select("o_orderpriority", "o_orderstatus", F.round("best", 2).alias("best"), "n", "place")


@query("SELECT round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS sigma, count(*) AS n, round(greatest(0.5, 2 * stddev_samp(value)), 8) AS least_gain FROM events WHERE event_type = 'view'")
def g16_noise_floor(t: Tables) -> DataFrame:
    out = M.noise_floor(t.events, "value", F.col("event_type") == "view", 0.5)
    return out.select(F.round("mean", 8).alias("mean"), F.round("sigma", 8).alias("sigma"), "n", F.round("least_gain", 8).alias("least_gain"))


@query("SELECT c_mktsegment, round(sum(c_acctbal) * 0.01, 4) AS low, round(sum(c_acctbal) * 0.03, 4) AS base, round(sum(c_acctbal) * 0.05, 4) AS high FROM customer GROUP BY 1")
def g18_impact(t: Tables) -> DataFrame:
    by = t.customer.groupBy("c_mktsegment").agg(M.impact_range(F.sum("c_acctbal"), 0.01, 0.03, 0.05).alias("x"))
    return by.select("c_mktsegment", *[F.round(f"x.{c}", 4).alias(c) for c in ("low", "base", "high")])


@query("SELECT corr_name AS \"column\", round(r, 8) AS r FROM (SELECT 'l_extendedprice' AS corr_name, abs(corr(l_extendedprice, l_quantity)) AS r FROM lineitem UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_quantity)) FROM lineitem) WHERE r > 0.3")
def c36_leakage_scan(t: Tables) -> DataFrame:
    pairs = A.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"]).filter("a = 'l_quantity'")
    return pairs.select(F.col("b").alias("column"), F.round(F.abs("r"), 8).alias("r")).filter("r > 0.3")


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE isinf(value)) AS infinite, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-25') AS future, count(*) FILTER (WHERE value = round(value, 0)) AS whole FROM events")
def q14_delivery(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.agg(F.count("*").alias("rows"), F.count_if(F.abs(v) == float("inf")).alias("infinite"), F.count_if(F.col("ts") > "2024-01-25").alias("future"), F.count_if(v == F.round(v, 0)).alias("whole"))


@query("SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'early' ELSE 'late' END || '; ' || event_type AS note FROM events")
def x31_notes(t: Tables) -> DataFrame:
    notes = F.array_compact(F.array(F.when(F.col("ts") < "2024-01-10", "early"), F.when(F.col("ts") >= "2024-01-10", "late"), F.col("event_type")))
    return t.events.select("event_id", F.array_join(notes, "; ").alias("note"))


@query("SELECT event_id, strftime(ts + INTERVAL 90 MINUTE, '%H:%M') AS eta FROM events")
def x32_clock(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_format(F.col("ts") + F.expr("INTERVAL 90 MINUTES"), "HH:mm").alias("eta"))


@query("WITH d AS (SELECT user_id, ts::DATE AS day, event_type FROM events) SELECT day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, count(*) AS n FROM d GROUP BY 1")
def l4_by_day(t: Tables) -> DataFrame:
    days = t.events.select(F.to_date("ts").alias("day"), "event_type")
    return days.groupBy("day").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), F.count("*").alias("n"))


@query(f"WITH {_RULES} SELECT '{{' || a || '}} => {{' || c || '}}' AS label, n11 FROM r")
def x25_rule_labels(t: Tables) -> DataFrame:
    return pair_rules(t).select(P.rule_label().alias("label"), "n11")

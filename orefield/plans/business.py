"""Cohorts, RFM, funnels, series, root causes, KPIs, change logs and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import business as B
from ..operators import quality as Q
from .base import Registry, Tables

query = Registry()
QUERIES, SQL = query.queries, query.sql

_COHORT = """c AS (SELECT DISTINCT o_custkey AS u, date_trunc('month', min(o_orderdate) OVER (PARTITION BY o_custkey))::DATE AS cohort, date_trunc('month', o_orderdate)::DATE AS active, o_orderkey, o_totalprice FROM orders),
    p AS (SELECT *, ((year(active) - year(cohort)) * 12 + month(active) - month(cohort))::INTEGER AS period_number FROM c)"""


@query(f"WITH {_COHORT} SELECT DISTINCT u AS o_custkey, cohort, active, period_number FROM p")
def b2_cohort_table(t: Tables) -> DataFrame:
    return B.cohort_table(t.orders, "o_custkey", "o_orderdate")


@query(f"WITH {_COHORT}, s AS (SELECT cohort, count(DISTINCT u) AS size FROM p GROUP BY 1) SELECT cohort, period_number, count(DISTINCT u) AS users, any_value(size) AS size, round(count(DISTINCT u) / any_value(size), 8) AS rate FROM p JOIN s USING (cohort) GROUP BY 1, 2")
def b3_retention(t: Tables) -> DataFrame:
    return B.retention(B.cohort_table(t.orders, "o_custkey", "o_orderdate"), "o_custkey").withColumn("rate", F.round("rate", 8))


@query(f"WITH {_COHORT} SELECT cohort, period_number, round(sum(o_totalprice), 2) AS revenue FROM p GROUP BY 1, 2")
def b4_revenue_retention(t: Tables) -> DataFrame:
    first = F.min("o_orderdate").over(Window.partitionBy("o_custkey"))
    rows = t.orders.select(B.period(first, "month").alias("cohort"), B.period(F.col("o_orderdate"), "month").alias("active"), "o_totalprice")
    return rows.groupBy("cohort", B.periods_between(F.col("cohort"), F.col("active"), "month").alias("period_number")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query("""WITH f AS (SELECT user_id, min(ts) AS f FROM events WHERE event_type = 'signup' GROUP BY 1), r AS (SELECT DISTINCT e.user_id, f::DATE AS cohort, ts::DATE AS active FROM events e JOIN f USING (user_id) WHERE ts >= f)
    SELECT user_id, cohort, active, (active - cohort)::INTEGER AS period_number FROM r""")
def b5_adoption(t: Tables) -> DataFrame:
    return B.cohort_table(t.events, "user_id", "ts", "day", started=F.col("event_type") == "signup")


@query(f"WITH {_COHORT}, s AS (SELECT cohort, count(DISTINCT u) AS size, count(DISTINCT CASE WHEN period_number = 1 THEN u END) AS back FROM p GROUP BY 1) SELECT count(*) AS cohorts, count(*) FILTER (WHERE size < 20) AS unreliable, round(max(back / size) - min(back / size), 8) AS spread FROM s")
def b6_reliability(t: Tables) -> DataFrame:
    table = B.cohort_table(t.orders, "o_custkey", "o_orderdate")
    s = table.groupBy("cohort").agg(F.count_distinct("o_custkey").alias("size"), F.count_distinct(F.when(F.col("period_number") == 1, F.col("o_custkey"))).alias("back"))
    rate = F.col("back") / F.col("size")
    return s.agg(F.count("*").alias("cohorts"), F.count_if(F.col("size") < 20).alias("unreliable"), F.round(F.max(rate) - F.min(rate), 8).alias("spread"))


@query("SELECT o_custkey, date_diff('day', max(o_orderdate)::DATE, (SELECT max(o_orderdate)::DATE + 1 FROM orders))::INTEGER AS recency, count(DISTINCT o_orderkey) AS frequency, round(sum(o_totalprice), 2) AS monetary FROM orders GROUP BY 1")
def b7_rfm(t: Tables) -> DataFrame:
    return B.rfm(t.orders, "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice").withColumn("monetary", F.round("monetary", 2))


@query("""WITH w AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer) SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(100 * avg(c_acctbal) / any_value(m), 6) AS index, round((avg(c_acctbal) - any_value(m)) / any_value(s), 8) AS z,
    CASE WHEN 100 * avg(c_acctbal) / any_value(m) >= 120 THEN 'over' WHEN 100 * avg(c_acctbal) / any_value(m) <= 80 THEN 'under' ELSE 'even' END AS label FROM customer, w GROUP BY 1""")
def b10_segment_index(t: Tables) -> DataFrame:
    out = B.segment_index(t.customer, "c_mktsegment", "c_acctbal")
    return out.withColumns({"mean": F.round("mean", 6), "index": F.round("index", 6), "z": F.round("z", 8)})


@query("""WITH u AS (SELECT user_id, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase' AND value > 100) AS p FROM events GROUP BY 1), s AS (SELECT count(*) FILTER (WHERE v) AS viewed, count(*) FILTER (WHERE v AND c) AS clicked, count(*) FILTER (WHERE v AND c AND p) AS bought FROM u),
    l AS (SELECT 1 AS place, 'viewed' AS step, viewed AS n, viewed AS a FROM s UNION ALL SELECT 2, 'clicked', clicked, viewed FROM s UNION ALL SELECT 3, 'bought', bought, viewed FROM s)
    SELECT place, step, n, round(n / lag(n) OVER (ORDER BY place), 8) AS from_before, round(n / a, 8) AS overall, lag(n) OVER (ORDER BY place) - n AS dropped FROM l""")
def b11_funnel(t: Tables) -> DataFrame:
    has = lambda e: F.bool_or(F.col("event_type") == e)
    users = t.events.groupBy("user_id").agg(has("view").alias("v"), has("click").alias("c"), F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 100)).alias("p"))
    counts = users.agg(F.count_if("v").alias("viewed"), F.count_if(F.col("v") & F.col("c")).alias("clicked"), F.count_if(F.col("v") & F.col("c") & F.col("p")).alias("bought"))
    return B.funnel(counts, ["viewed", "clicked", "bought"]).withColumns({c: F.round(c, 8) for c in ("from_before", "overall")})


@query("WITH u AS (SELECT c_mktsegment AS s, o_custkey, count(DISTINCT o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT s AS c_mktsegment, k::INTEGER AS orders, count(*) FILTER (WHERE n >= k) AS customers, round(count(*) FILTER (WHERE n >= k) / count(*), 8) AS overall FROM u, range(1, 6) r(k) GROUP BY 1, 2")
def b12_repeat_funnel(t: Tables) -> DataFrame:
    users = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_custkey").agg(F.count_distinct("o_orderkey").alias("n"))
    steps = users.groupBy("c_mktsegment").agg(F.count("*").alias("all"), *[F.count_if(F.col("n") >= k).alias(f"n{k}") for k in range(1, 6)])
    long = steps.select("c_mktsegment", "all", F.inline(F.array(*[F.struct(F.lit(k).alias("orders"), F.col(f"n{k}").alias("customers")) for k in range(1, 6)])))
    return long.select("c_mktsegment", "orders", "customers", F.round(F.col("customers") / F.col("all"), 8).alias("overall"))


@query("""WITH r AS (SELECT o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders), g AS (SELECT date_diff('day', max(o_orderdate) FILTER (WHERE r = 1), max(o_orderdate) FILTER (WHERE r = 2)) AS gap FROM r GROUP BY o_custkey)
    SELECT count(gap) AS n, quantile_cont(gap, 0.5) AS p50, quantile_cont(gap, 0.9) AS p90 FROM g""")
def b13_time_to_convert(t: Tables) -> DataFrame:
    r = t.orders.select("o_custkey", "o_orderdate", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("r")).filter("r <= 2")
    nth = lambda n: F.max(F.when(F.col("r") == n, F.col("o_orderdate")))
    return r.groupBy("o_custkey").agg(F.datediff(nth(2), nth(1)).alias("gap")).agg(F.count("gap").alias("n"), F.percentile("gap", F.lit(0.5)).alias("p50"), F.percentile("gap", F.lit(0.9)).alias("p90"))


_DAY = "d0 AS (SELECT o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1), d AS (SELECT s.day, coalesce(v, 0) AS v FROM (SELECT unnest(generate_series((SELECT min(day) FROM d0), (SELECT max(day) FROM d0), INTERVAL 1 DAY))::DATE AS day) s LEFT JOIN d0 USING (day))"


def daily(t: Tables) -> DataFrame:
    return B.calendar(t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("v")), "day", "v")


@query(f"WITH {_DAY} SELECT day, v FROM d")
def b14_calendar(t: Tables) -> DataFrame:
    return daily(t)


@query(f"WITH {_DAY}, i AS (SELECT v, row_number() OVER (ORDER BY day) - 1 AS i FROM d), s AS (SELECT regr_slope(v, i) AS slope, avg(v) AS m FROM i) SELECT round(slope, 4) AS slope, round(100 * slope / m, 6) AS pct, CASE WHEN abs(100 * slope / m) < 0.1 THEN 'flat' WHEN slope > 0 THEN 'up' ELSE 'down' END AS direction FROM s")
def b15_trend(t: Tables) -> DataFrame:
    return B.trend(daily(t), "day", "v").withColumns({"slope": F.round("slope", 4), "pct": F.round("pct", 6)})


@query(f"WITH {_DAY}, s AS (SELECT avg(v) AS m, stddev_samp(v) AS s FROM d) SELECT day, v, round((v - m) / s, 8) AS z, CASE WHEN v > m THEN 'spike' ELSE 'dip' END AS kind FROM d, s WHERE abs((v - m) / s) >= 1.5")
def b16_spikes(t: Tables) -> DataFrame:
    return B.spikes(daily(t), "day", "v", 1.5).withColumn("z", F.round("z", 8))


@query(f"WITH {_DAY} SELECT count(*) AS n, round(sum(v), 2) AS total, round(avg(v), 4) AS mean, min(v) AS lo, max(v) AS hi, round(quantile_cont(v, 0.5), 4) AS median FROM d")
def b17_series_summary(t: Tables) -> DataFrame:
    return daily(t).agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"), F.round(F.avg("v"), 4).alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.round(F.percentile("v", F.lit(0.5)), 4).alias("median"))


@query(f"""WITH {_DAY}, i AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, CASE WHEN count(v) OVER w = 7 THEN avg(v) OVER w END AS trend FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    p AS (SELECT i % 7 AS f, avg(v - trend) AS p FROM i GROUP BY 1) SELECT day, v, round(trend, 4) AS trend, round(p - (SELECT avg(p) FROM p), 4) AS seasonal, round(v - trend - (p - (SELECT avg(p) FROM p)), 4) AS rest FROM i JOIN p ON i % 7 = f""")
def b18_decompose(t: Tables) -> DataFrame:
    return B.decompose(daily(t), "day", "v").withColumns({c: F.round(c, 4) for c in ("trend", "seasonal", "rest")})


@query(f"WITH {_DAY} SELECT (isodow(day) - 1)::INTEGER AS dow, round(avg(v), 4) AS mean FROM d GROUP BY 1")
def b19_weekday_profile(t: Tables) -> DataFrame:
    return daily(t).groupBy(F.weekday("day").alias("dow")).agg(F.round(F.avg("v"), 4).alias("mean"))


@query(f"WITH {_DAY}, f AS (SELECT v AS y, lag(v, 7) OVER (ORDER BY day) AS f, row_number() OVER (ORDER BY day DESC) AS r FROM d) SELECT round(avg(CASE WHEN y <> 0 THEN 100 * abs(y - f) / abs(y) END), 6) AS mape, round(avg(abs(y - f)), 4) AS mae FROM f WHERE r <= 28")
def b20_forecast(t: Tables) -> DataFrame:
    return B.forecast_scores(daily(t), "day", "v", 28).select(F.round("mape", 6).alias("mape"), F.round("mae", 4).alias("mae"))


@query("""WITH o AS (SELECT o_orderpriority, o_orderstatus, CASE WHEN year(o_orderdate) = 1996 THEN o_totalprice ELSE 0 END AS a, CASE WHEN year(o_orderdate) = 1997 THEN o_totalprice ELSE 0 END AS b FROM orders), l AS (SELECT 'o_orderpriority' AS dimension, o_orderpriority AS level, a, b FROM o UNION ALL SELECT 'o_orderstatus', o_orderstatus, a, b FROM o)
    SELECT dimension, level, round(sum(a), 2) AS "before", round(sum(b), 2) AS "after", round(sum(b) - sum(a), 2) AS change, round(100 * (sum(b) - sum(a)) / (SELECT sum(b) - sum(a) FROM o), 4) AS share FROM l GROUP BY 1, 2""")
def b21_drill_down(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    out = B.drill_down(t.orders, ["o_orderpriority", "o_orderstatus"], "o_totalprice", (d >= "1996-01-01") & (d < "1997-01-01"), (d >= "1997-01-01") & (d < "1998-01-01"))
    return out.withColumns({"before": F.round("before", 2), "after": F.round("after", 2), "change": F.round("change", 2), "share": F.round("share", 4)})


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS orders, round(avg(o_totalprice), 4) AS aov FROM orders GROUP BY 1)
    SELECT month, orders, aov, round((orders - lag(orders) OVER w) * lag(aov) OVER w, 4) AS by_orders, round((aov - lag(aov) OVER w) * orders, 4) AS by_aov FROM m WINDOW w AS (ORDER BY month)""")
def b22_orders_times_aov(t: Tables) -> DataFrame:
    m = B.query_metric(t.orders, {"orders": F.count("*"), "a": F.round(F.avg("o_totalprice"), 4)}, [], ("o_orderdate", "month"))
    w = Window.orderBy("period")
    return m.select(F.col("period").alias("month"), "orders", F.col("a").alias("aov"), F.round((F.col("orders") - F.lag("orders").over(w)) * F.lag("a").over(w), 4).alias("by_orders"), F.round((F.col("a") - F.lag("a").over(w)) * F.col("orders"), 4).alias("by_aov"))


@query("WITH m AS (SELECT max(o_orderdate)::DATE AS d FROM orders), l AS (SELECT sum(o_totalprice) AS s FROM orders, m WHERE o_orderdate >= date_trunc('month', d)) SELECT d AS last_day, d < last_day(d) AS partial, round(s * day(last_day(d)) / day(d), 2) AS prorated FROM m, l")
def b23_partial_period(t: Tables) -> DataFrame:
    end = t.orders.agg(F.to_date(F.max("o_orderdate")).alias("d"))
    last = t.orders.crossJoin(F.broadcast(end)).filter(F.col("o_orderdate") >= F.date_trunc("month", "d")).groupBy("d").agg(F.sum("o_totalprice").alias("s"))
    return last.select(F.col("d").alias("last_day"), (F.col("d") < F.last_day("d")).alias("partial"), F.round(F.col("s") * F.dayofmonth(F.last_day("d")) / F.dayofmonth("d"), 2).alias("prorated"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS booked FROM orders), b AS (SELECT l_orderkey AS k, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS lines FROM lineitem GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, coalesce(booked, 0) AS booked, coalesce(lines, 0) AS lines, round(coalesce(booked, 0) - coalesce(lines, 0), 2) AS difference FROM a FULL JOIN b ON a.k = b.k""")
def b24_reconcile(t: Tables) -> DataFrame:
    a = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("booked"))
    lines = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 2).alias("lines")
    out = B.reconcile(a, t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(lines), ["k"], "booked", "lines")
    return out.withColumn("difference", F.round("difference", 2))


@query("""WITH c AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT round(sum(s), 2) AS gmv, sum(n)::BIGINT AS orders, round(sum(s) / sum(n), 4) AS aov, round(sum(n) / count(*), 6) AS per_customer, round(avg((n > 1)::INT), 6) AS repeat_rate,
    (SELECT round(avg((l_returnflag = 'R')::INT), 6) FROM lineitem) AS return_rate FROM c""")
def b25_kpis(t: Tables) -> DataFrame:
    c = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    kpi = c.agg(F.round(F.sum("s"), 2).alias("gmv"), F.sum("n").alias("orders"), F.round(F.sum("s") / F.sum("n"), 4).alias("aov"), F.round(F.sum("n") / F.count("*"), 6).alias("per_customer"), F.round(F.avg((F.col("n") > 1).cast("int")), 6).alias("repeat_rate"))
    return kpi.crossJoin(t.lineitem.agg(F.round(F.avg((F.col("l_returnflag") == "R").cast("int")), 6).alias("return_rate")))


@query("""WITH p AS (SELECT o_custkey AS u, date_trunc('month', o_orderdate)::DATE AS m, sum(o_totalprice) AS now FROM orders GROUP BY 1, 2), q AS (SELECT u, (m + INTERVAL 1 MONTH)::DATE AS m, now AS was FROM p),
    b AS (SELECT coalesce(p.m, q.m) AS m, coalesce(now, 0) AS now, coalesce(was, 0) AS was FROM p FULL JOIN q ON p.u = q.u AND p.m = q.m)
    SELECT m AS month, round(sum(CASE WHEN was = 0 THEN now ELSE 0 END), 2) AS new, round(sum(CASE WHEN was > 0 AND now > was THEN now - was ELSE 0 END), 2) AS expansion, round(sum(CASE WHEN now > 0 AND was > now THEN was - now ELSE 0 END), 2) AS contraction, round(sum(CASE WHEN now = 0 THEN was ELSE 0 END), 2) AS churned, round(sum(now), 2) AS ends FROM b GROUP BY 1""")
def b26_revenue_bridge(t: Tables) -> DataFrame:
    paid = t.orders.select("o_custkey", B.period(F.col("o_orderdate"), "month").alias("month"), "o_totalprice")
    out = B.revenue_bridge(paid, "o_custkey", "month", "o_totalprice")
    return out.select("month", *[F.round(c, 2).alias(c) for c in out.columns[1:]])


@query("SELECT o_orderstatus, date_trunc('month', o_orderdate)::DATE AS period, count(*) AS orders, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice) / count(*), 4) AS aov FROM orders GROUP BY 1, 2")
def b27_metric_layer(t: Tables) -> DataFrame:
    metrics = {"orders": F.count("*"), "customers": F.count_distinct("o_custkey"), "aov": F.round(F.sum("o_totalprice") / F.count("*"), 4)}
    return B.query_metric(t.orders, metrics, ["o_orderstatus"], ("o_orderdate", "month"))


_FOLD = """e AS (SELECT user_id, event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS kind, CASE WHEN value > 50 THEN value END AS value, event_type = 'error' AS deleted FROM events),
    s AS (SELECT user_id, arg_max(kind, seq) FILTER (WHERE kind IS NOT NULL) AS kind, arg_max(value, seq) FILTER (WHERE value IS NOT NULL) AS value, max(seq) AS seq, arg_max(deleted, seq) AS gone FROM e GROUP BY 1)"""


def change_log(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click"), F.col("event_type"))
    return t.events.select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("value") > 50, F.col("value")).alias("value"), (F.col("event_type") == "error").alias("deleted"))


@query(f"WITH {_FOLD} SELECT user_id, kind, value, seq FROM s WHERE NOT gone")
def b28_upsert_fold(t: Tables) -> DataFrame:
    return B.folded(change_log(t), "user_id", "seq", ["kind", "value"])


@query(f"WITH {_FOLD} SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM s WHERE gone)")
def b30_cascade(t: Tables) -> DataFrame:
    log = change_log(t)
    alive = B.folded(log, "user_id", "seq", ["kind"]).select("user_id")
    gone = log.select("user_id").distinct().join(alive, "user_id", "left_anti")
    return B.cascade(t.events, gone, "user_id").select("event_id")


@query("SELECT c_custkey, c_name, count(o_orderkey) AS orders, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def b31_snapshot(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey", "c_name").agg(F.count("o_orderkey").alias("orders"), F.max("o_orderdate").alias("last"))


@query("SELECT p_brand, 'Brand ' || p_brand || ' sold ' || count(*)::VARCHAR || ' lines.' AS text FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) * (SELECT count(DISTINCT p_brand) FROM lineitem JOIN part ON l_partkey = p_partkey) > (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey)")
def b33_text_pairs(t: Tables) -> DataFrame:
    by = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count("*").alias("n"))
    by = by.crossJoin(by.agg(F.avg("n").alias("mean"))).filter("n > mean")  # one row
    return by.select("p_brand", F.format_string("Brand %s sold %d lines.", "p_brand", "n").alias("text"))


# quality


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / count(*), 4)::DOUBLE AS pct, CASE WHEN count(*) - count({c}) > 0.5 * count(*) THEN 'FAIL' WHEN count(*) - count({c}) > 0.05 * count(*) THEN 'WARN' ELSE 'OK' END AS status FROM (SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))" for c in ("doc_id", "source", "quality", "toxic")))
def q1_null_profile(t: Tables) -> DataFrame:
    return Q.null_profile(t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left"), fail=0.5)


@query("""WITH d AS (SELECT l_orderkey, l_suppkey FROM lineitem), f AS (SELECT count(*) AS n FROM d GROUP BY l_orderkey, l_suppkey) SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS extra_rows, (SELECT sum(n) FROM (SELECT count(*) AS n FROM d GROUP BY l_orderkey) WHERE n > 1)::BIGINT AS key_rows,
    (SELECT count(*) FROM (SELECT count(*) AS n FROM d GROUP BY l_orderkey) WHERE n > 1) AS keys FROM f""")
def q3_duplicates(t: Tables) -> DataFrame:
    return Q.duplicate_audit(t.lineitem.select("l_orderkey", "l_suppkey"), ["l_orderkey"])


@query("""WITH o AS (SELECT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) SELECT (SELECT count(*) FROM orders) AS rows, count(*) AS orphans, round(100.0 * count(*) / (SELECT count(*) FROM orders), 4)::DOUBLE AS pct,
    (SELECT string_agg(k::VARCHAR, ',' ORDER BY k) FROM (SELECT DISTINCT o_custkey AS k FROM o ORDER BY k LIMIT 5)) AS sample FROM o""")
def q4_integrity(t: Tables) -> DataFrame:
    return Q.integrity(t.orders, t.customer.filter("c_acctbal > 0"), "o_custkey", "c_custkey")


@query(" UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE NOT ({c})) AS violations, round(count(*) FILTER (WHERE NOT ({c})) / count(*), 8) AS share FROM lineitem" for n, c in (("discount", "l_discount BETWEEN 0 AND 0.08"), ("flag", "l_returnflag IN ('A', 'N')"))))
def q5_ranges(t: Tables) -> DataFrame:
    return Q.range_report(t.lineitem, {"discount": F.col("l_discount").between(0, 0.08), "flag": F.col("l_returnflag").isin("A", "N")})


@query("SELECT (SELECT count(c_custkey) = count(DISTINCT c_custkey) FROM customer) AS \"unique\", round(avg((c_custkey IS NOT NULL)::INT), 8) AS contained FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) ON o_custkey = c_custkey")
def q6_inferred_key(t: Tables) -> DataFrame:
    return Q.inferred_key(t.orders, "o_custkey", t.customer.filter("c_nationkey < 20"), "c_custkey").withColumn("contained", F.round("contained", 8))


@query("SELECT max(ts) AS newest, (DATE '2024-02-15' - max(ts)::DATE)::INTEGER AS lag_days, CASE WHEN DATE '2024-02-15' - max(ts)::DATE > 7 THEN 'STALE' ELSE 'FRESH' END AS status FROM events")
def q7_freshness(t: Tables) -> DataFrame:
    return Q.freshness(t.events, "ts", "2024-02-15", 7)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(any_value(q1 - 1.5 * (q3 - q1)), 6) AS low, round(any_value(q3 + 1.5 * (q3 - q1)), 6) AS high, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS by_fence, count(*) FILTER (WHERE abs(({c} - m) / s) > 3) AS by_z FROM {t}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, avg({c}) AS m, stddev_samp({c}) AS s FROM {t})" for c, t in (("value", "events"),)))
def q8_outliers(t: Tables) -> DataFrame:
    return Q.outliers(t.events, ["value"]).withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query("SELECT 'rows' AS gate, count(*)::DOUBLE AS value, CASE WHEN count(*) BETWEEN 100 AND 1e12 THEN 'pass' ELSE 'warn' END AS status FROM orders UNION ALL SELECT 'open_share', round(avg((o_orderstatus = 'O')::INT), 8), CASE WHEN avg((o_orderstatus = 'O')::INT) BETWEEN 0.4 AND 0.6 THEN 'pass' ELSE 'warn' END FROM orders")
def q9_gates(t: Tables) -> DataFrame:
    return Q.gates(t.orders, {"rows": (F.count("*"), 100, 1e12), "open_share": (F.round(F.avg((F.col("o_orderstatus") == "O").cast("int")), 8), 0.4, 0.6)})


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE abs(l_extendedprice - l_quantity * p_retailprice) > 0.01) AS broken FROM lineitem JOIN part ON l_partkey = p_partkey")
def q12_identity(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.agg(F.count("*").alias("rows"), F.count_if(F.abs(F.col("l_extendedprice") - F.col("l_quantity") * F.col("p_retailprice")) > 0.01).alias("broken"))


@query("WITH c AS (SELECT 'toxic' AS \"column\", toxic::VARCHAR AS value, count(*) AS n FROM labels GROUP BY toxic UNION ALL SELECT 'quality', quality::VARCHAR, count(*) FROM labels GROUP BY quality) SELECT \"column\", arg_max(value, n) AS value, round(max(n) / sum(n), 8) AS share FROM c GROUP BY 1 HAVING max(n) / sum(n) > 0.6")
def q13_near_constant(t: Tables) -> DataFrame:
    return Q.near_constant(t.labels, ["toxic", "quality"], 0.6).withColumn("share", F.round("share", 8))


@query(" UNION ALL ".join(f"SELECT 'customer' AS \"table\", '{c}' AS \"column\", '{k}' AS type, count(*) AS rows, count({c}) AS non_null, count(DISTINCT {c}) AS \"distinct\", round(100 * (1 - count({c}) / count(*)), 4)::DOUBLE AS null_pct FROM customer" for c, k in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))))
def q15_dictionary(t: Tables) -> DataFrame:
    return Q.dictionary(t.customer.withColumn("c_nationkey", F.col("c_nationkey").cast("int")), "customer")


@query("SELECT toxic IS NULL AS missing, count(*) AS n, round(avg(n_chars), 6) AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def q17_missing_informative(t: Tables) -> DataFrame:
    return Q.missing_informative(t.documents.join(t.labels, "doc_id", "left"), "toxic", "n_chars").withColumn("rate", F.round("rate", 6))

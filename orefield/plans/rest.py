"""The remaining operators that SQL can check: ranks, steps, landmarks, productivity, warehouse, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as X
from ..functions.measures import measured
from ..operators import aggregates as A
from ..operators import business as B
from ..operators import evaluation as E
from ..operators import patterns as P
from ..operators import quality as Q
from ..operators import sampling
from ..operators import text as K
from ..operators.ordering import running_by_range, tiled
from .base import Registry, Tables
from .corpus import _FREQ, _PLACES, places
from .mining import _RULES, pair_rules, shown

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("""WITH c AS (SELECT l_linenumber AS x, l_discount AS y, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM c a, c b), t AS (SELECT sum(n) AS n FROM c),
    tx AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM c GROUP BY x)), ty AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM c GROUP BY y)) SELECT round(s / sqrt((t.n * (t.n - 1) / 2 - tx.t) * (t.n * (t.n - 1) / 2 - ty.t)), 8) AS tau FROM p, t, tx, ty""")
def a15_kendall(t: Tables) -> DataFrame:
    """Tau-b of two columns of few values."""
    return A.kendall(t.lineitem, "l_linenumber", "l_discount").select(F.round("tau", 8).alias("tau"))


@query("""WITH c AS (SELECT o_totalprice AS x, o_orderdate AS y FROM orders), p AS (SELECT sum(CASE WHEN (a.x < b.x) = (a.y < b.y) THEN 1 ELSE -1 END) FILTER (WHERE a.x <> b.x AND a.y <> b.y) / 2 AS s FROM c a, c b),
    t AS (SELECT count(*) AS n FROM c), tx AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT count(*) AS n FROM c GROUP BY x)), ty AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT count(*) AS n FROM c GROUP BY y))
    SELECT round(s / sqrt((t.n * (t.n - 1) / 2 - tx.t) * (t.n * (t.n - 1) / 2 - ty.t)), 8) AS tau FROM p, t, tx, ty""")
def a15_kendall_many(t: Tables) -> DataFrame:
    """Tau-b of two columns of many values."""
    return A.kendall(t.orders, "o_totalprice", "o_orderdate").select(F.round("tau", 8).alias("tau"))


@query("WITH s AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), o AS (SELECT *, lag(n) OVER (ORDER BY event_type) AS b FROM s) SELECT event_type, n, round(n / b, 8) AS ratio FROM o")
def w5_step_ratio(t: Tables) -> DataFrame:
    s = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return s.select("event_type", "n", F.round(F.col("n") / F.lag("n").over(Window.orderBy("event_type")), 8).alias("ratio"))


@query("SELECT c_custkey, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2 AS r FROM customer")
def w8_average_rank(t: Tables) -> DataFrame:
    return A.average_rank(t.customer, "c_nationkey", "r").select("c_custkey", "r")


@query("""WITH d AS (SELECT o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1), m AS (SELECT day, v, quantile_cont(v, 0.5) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 6 FOLLOWING) AS med FROM d), s AS (SELECT stddev_samp(v - med) AS s, avg(v - med) AS m FROM m)
    SELECT day, round((v - med - m) / s, 6) AS z FROM m, s WHERE abs((v - med - m) / s) > 3""")
def w17_median_anomalies(t: Tables) -> DataFrame:
    d = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    off = d.select("day", (F.col("v") - F.percentile("v", F.lit(0.5)).over(Window.orderBy("day").rowsBetween(-7, 6))).alias("x"))
    both = off.crossJoin(F.broadcast(off.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))))
    z = (F.col("x") - F.col("m")) / F.col("s")
    return both.filter(F.abs(z) > 3).select("day", F.round(z, 6).alias("z"))


@query("SELECT p_partkey FROM part ORDER BY p_size DESC, p_name ASC, p_partkey LIMIT 100")
def l1_multi_sort(t: Tables) -> DataFrame:
    return t.part.orderBy(F.desc_nulls_last("p_size"), F.asc_nulls_last("p_name"), "p_partkey").select("p_partkey").limit(100)


@query("WITH d AS (SELECT ntile(10) OVER (ORDER BY o_totalprice, o_orderkey) AS d FROM orders) SELECT d::INTEGER AS decile, least(count(*), 5) AS picked FROM d GROUP BY 1")
def l14_decile_probe(t: Tables) -> DataFrame:
    decile = tiled(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 10, "decile")
    place = F.row_number().over(Window.partitionBy("decile").orderBy(sampling.hash_order("o_orderkey", 7), "o_orderkey"))
    return decile.withColumn("p", place).filter("p <= 5").groupBy("decile").agg(F.count("*").alias("picked"))


@query(f"WITH {_PLACES}, l AS (SELECT c_custkey, radians(c - a) * 6371.0088 AS n, radians(d - b) * cos(radians((a + c) / 2)) * 6371.0088 AS e, 2 * 6371.0088 * asin(sqrt(sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2)) AS h FROM p) SELECT c_custkey, round((abs(e * cos(radians(29)) + n * sin(radians(29))) + abs(n * cos(radians(29)) - e * sin(radians(29)))) / greatest(h, 0.05), 8) AS detour FROM l")
def x4_detour(t: Tables) -> DataFrame:
    p = [F.col(c) for c in "abcd"]
    return places(t).select("c_custkey", F.round(X.grid_km(*p) / F.greatest(X.haversine_km(*p), F.lit(0.05)), 8).alias("detour"))


_LANDMARKS = {"jfk": (40.6413, -73.7781), "lga": (40.7769, -73.8740)}
_H = "2 * 6371.0088 * asin(sqrt(sin(radians({y} - a) / 2) ** 2 + cos(radians(a)) * cos(radians({y})) * sin(radians({x} - b) / 2) ** 2))"


@query(f"WITH {_PLACES} SELECT c_custkey, " + ", ".join(f"round({_H.format(y=y, x=x)}, 8) AS km_{n}" for n, (y, x) in _LANDMARKS.items()) + ", (" + " OR ".join(f"{_H.format(y=y, x=x)} < 20" for y, x in _LANDMARKS.values()) + ")::INTEGER AS near FROM p")
def x6_landmarks(t: Tables) -> DataFrame:
    km = {n: X.haversine_km(F.col("a"), F.col("b"), F.lit(y), F.lit(x)) for n, (y, x) in _LANDMARKS.items()}
    return places(t).select("c_custkey", *[F.round(c, 8).alias(f"km_{n}") for n, c in km.items()], (F.least(*km.values()) < 20).cast("int").alias("near"))


@query("SELECT l_orderkey, l_linenumber, ((year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate))::INTEGER AS months, (DATE '2002-01-01' - l_shipdate::DATE)::INTEGER AS days_since FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def x11_x12_distances(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", B.periods_between(F.col("o_orderdate"), F.col("l_shipdate"), "month").alias("months"), F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("l_shipdate")).alias("days_since"))


@query("WITH b AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem GROUP BY 1) SELECT k, unnest(list_filter([list_filter(s, lambda x, i: (m >> (i - 1)) & 1 = 1) FOR m IN range(1, (1 << len(s)) - 1)], lambda x: len(x) <= 2)) AS subset FROM b WHERE len(s) BETWEEN 2 AND 4")
def x26_subsets(t: Tables) -> DataFrame:
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("s")).filter(F.size("s").between(2, 4))
    return b.select("k", F.explode(P.subsets(F.col("s"), 2)).alias("subset"))


@query(f"WITH {_RULES} SELECT a, c, n11 FROM r WHERE n11 * n > n1 * m1")
def p14_attached(t: Tables) -> DataFrame:
    """Rules joined with a report of theirs."""
    rules = shown(pair_rules(t), "n11", "n1", "m1", "n")
    report = rules.select("a", "c", (F.col("n11") * F.col("n") > F.col("n1") * F.col("m1")).alias("positive"))
    return rules.join(report, ["a", "c"], "left").filter("positive").select("a", "c", "n11")


@query(f"WITH {_RULES}, m AS (SELECT n11 / n1 AS conf, n11 * n / (n1 * m1) AS lift, n11 / n - n1 / n * m1 / n AS lev FROM r) SELECT count(*) AS rules, round(avg(lift), 8) AS lift, round(avg(abs(lev)), 8) AS leverage, round(count(*) FILTER (WHERE lift > 1) / count(*), 8) AS positive FROM m")
def p20_objective_parts(t: Tables) -> DataFrame:
    m = measured(pair_rules(t), ["lift", "leverage"])
    return m.agg(F.count("*").alias("rules"), F.round(F.avg("lift"), 8).alias("lift"), F.round(F.avg(F.abs("leverage")), 8).alias("leverage"), F.round(F.avg((F.col("lift") > 1).cast("double")), 8).alias("positive"))


@query("""WITH f AS (SELECT doc_id, n_chars, source FROM documents), s AS (SELECT quantile_cont(n_chars / (length(source) + 1e-9), 0.995) AS cap FROM f) SELECT doc_id, round(least(n_chars / (length(source) + 1e-9), cap), 6) AS ratio FROM f, s""")
def c6_capped_ratio(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", (F.col("n_chars") / (F.length("source") + 1e-9)).alias("ratio"))
    return E.winsorised(rows, ["ratio"], 0.0, 0.995).select("doc_id", F.round("ratio", 6).alias("ratio"))


@query("WITH r AS (SELECT o_orderpriority AS g, o_totalprice AS v, o_orderkey % 2 AS h FROM orders), a AS (SELECT h, g, count(*) / sum(count(*)) OVER (PARTITION BY h) AS p FROM r GROUP BY 1, 2) SELECT x.g, round(x.p, 8) AS reference, round(y.p, 8) AS current, round((y.p - x.p) * ln(y.p / x.p), 10) AS psi FROM a x JOIN a y ON x.g = y.g AND x.h = 0 AND y.h = 1")
def c30_mix_drift(t: Tables) -> DataFrame:
    def mix(h, name):
        rows = t.orders.filter(F.col("o_orderkey") % 2 == h)
        return rows.groupBy(F.col("o_orderpriority").alias("g")).agg(F.count("*").alias("k")).crossJoin(F.broadcast(rows.agg(F.count("*").alias("t")))).select("g", (F.col("k") / F.col("t")).alias(name))
    both = mix(0, "reference").join(mix(1, "current"), "g", "full_outer")
    e, a = F.col("reference"), F.col("current")
    return both.select("g", F.round(e, 8).alias("reference"), F.round(a, 8).alias("current"), F.round((a - e) * F.ln(a / e), 10).alias("psi"))


@query("""WITH c AS (SELECT o_custkey AS customer, count(*) AS orders, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1) SELECT count(*) AS customers, sum(orders)::BIGINT AS orders, min(first) AS first, max(last) AS last, (SELECT count(*) FROM (SELECT DISTINCT l_partkey FROM lineitem)) AS products FROM c""")
def b1_star_schema_sizes(t: Tables) -> DataFrame:
    """The dimension and fact tables built from flat lines, summed up."""
    customers = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    products = t.lineitem.groupBy("l_partkey").agg(F.avg("l_extendedprice").alias("price"))
    return customers.agg(F.count("*").alias("customers"), F.sum("orders").alias("orders"), F.min("first").alias("first"), F.max("last").alias("last")).crossJoin(products.agg(F.count("*").alias("products")))


@query("""WITH r AS (SELECT o_custkey, count(*) AS f, sum(o_totalprice) AS m FROM orders GROUP BY 1), q AS (SELECT quantile_cont(f, 0.5) AS f, quantile_cont(m, 0.5) AS m FROM r) SELECT CASE WHEN r.f > q.f AND r.m > q.m THEN 'champions' WHEN r.f > q.f THEN 'frequent' WHEN r.m > q.m THEN 'big tickets' ELSE 'occasional' END AS segment, count(*) AS customers FROM r, q GROUP BY 1""")
def b9_named_segments(t: Tables) -> DataFrame:
    r = B.rfm(t.orders, "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    q = r.agg(F.percentile("frequency", F.lit(0.5)).alias("qf"), F.percentile("monetary", F.lit(0.5)).alias("qm"))
    often, much = F.col("frequency") > F.col("qf"), F.col("monetary") > F.col("qm")
    name = F.when(often & much, "champions").when(often, "frequent").when(much, "big tickets").otherwise("occasional")
    return r.crossJoin(F.broadcast(q)).groupBy(name.alias("segment")).agg(F.count("*").alias("customers"))


@query("WITH p AS (SELECT json_extract_string(props, '$.k')::INTEGER AS k, event_id % 100 AS guess FROM events) SELECT count(*) AS n, round(avg((k IS NOT NULL)::INT), 8) AS valid, round(avg((k = guess)::INT), 8) AS exact FROM p")
def b34_extraction_scores(t: Tables) -> DataFrame:
    rows = t.events.select(F.get_json_object("props", "$.k").cast("int").alias("k"), (F.col("event_id") % 100).alias("guess"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.col("k").isNotNull().cast("int")), 8).alias("valid"), F.round(F.avg((F.col("k") == F.col("guess")).cast("int")), 8).alias("exact"))


@query(f"WITH {_FREQ}, r AS (SELECT token, n, sum(n) OVER (ORDER BY n DESC, token) / (SELECT sum(n) FROM f) AS c FROM f) SELECT least(floor(c * 10), 9)::INTEGER AS decile, count(*) AS types, round(avg(length(token)), 8) AS letters FROM r GROUP BY 1")
def k16_frequency_deciles(t: Tables) -> DataFrame:
    f = K.frequencies(t.documents)
    both = running_by_range(f, [F.desc("n"), F.asc("token")], {"c": F.col("n")}).crossJoin(F.broadcast(f.agg(F.sum("n").alias("total"))))
    return both.groupBy(F.least(F.floor(F.col("c") / F.col("total") * 10), F.lit(9)).cast("int").alias("decile")).agg(F.count("*").alias("types"), F.round(F.avg(F.length("token")), 8).alias("letters"))


@query(r"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, ' ?[a-z]+| ?[0-9]+')) AS token FROM benchmark) GROUP BY 1")
def k10_pretokens(t: Tables) -> DataFrame:
    return t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit(" ?[a-z]+| ?[0-9]+"), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT 'doc_id' AS \"column\", 0::BIGINT AS nulls, 'OK' AS status UNION ALL SELECT 'toxic', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), CASE WHEN (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) > 0.9 * (SELECT count(*) FROM documents) THEN 'FAIL' ELSE 'WARN' END")
def q2_null_thresholds(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    return Q.null_profile(joined, thresholds={"toxic": 0.9}).select("column", "nulls", "status")


@query("SELECT l_returnflag AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 8) AS share FROM lineitem GROUP BY 1 ORDER BY n DESC LIMIT 5")
def q10_column_profile(t: Tables) -> DataFrame:
    by = t.lineitem.groupBy(F.col("l_returnflag").alias("value")).agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("t")))).select("value", "n", F.round(F.col("n") / F.col("t"), 8).alias("share")).orderBy(F.desc("n")).limit(5)


@query("SELECT 'c_acctbal' AS \"column\", count(*) FILTER (WHERE c_acctbal < 0) AS negative, round(avg((c_acctbal = 0)::INT), 8) AS zero_share, CASE WHEN count(*) FILTER (WHERE c_acctbal < 0) > 0.05 * count(*) THEN 'high' ELSE 'low' END AS severity FROM customer")
def q11_audit(t: Tables) -> DataFrame:
    c = F.col("c_acctbal")
    return t.customer.agg(F.lit("c_acctbal").alias("column"), F.count_if(c < 0).alias("negative"), F.round(F.avg((c == 0).cast("int")), 8).alias("zero_share"), F.when(F.count_if(c < 0) > 0.05 * F.count("*"), "high").otherwise("low").alias("severity"))


@query("SELECT 'all' AS subset, round(avg((toxic IS NULL)::INT), 8) AS missing FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'english', round(avg((toxic IS NULL)::INT), 8) FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'en'")
def q18_missing_by_subset(t: Tables) -> DataFrame:
    gone = F.col("toxic").isNull().cast("int")
    one = t.documents.join(t.labels, "doc_id", "left").agg(F.round(F.avg(gone), 8).alias("a"), F.round(F.avg(F.when(F.col("lang") == "en", gone)), 8).alias("e"))
    return one.select(F.inline(F.array(F.struct(F.lit("all").alias("subset"), F.col("a").alias("missing")), F.struct(F.lit("english").alias("subset"), F.col("e").alias("missing")))))


@query("WITH b AS (SELECT count(*) AS rows, count(DISTINCT user_id) AS users, min(ts) AS first, max(ts) AS last, round(sum(value), 4) AS total FROM events) SELECT * FROM b")
def q19_table_profile(t: Tables) -> DataFrame:
    return t.events.agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.round(F.sum("value"), 4).alias("total"))

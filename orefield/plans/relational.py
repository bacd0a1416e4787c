"""Projections, filters, joins, aggregates, windows, sorts and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import aggregates as A
from ..operators import filters, joins, sampling
from ..operators.ordering import placed, running
from ..operators.quantiles import quantiles
from .base import Registry, Tables

query = Registry()
QUERIES, SQL = query.queries, query.sql
TOP_SQL = """SELECT c_custkey, c_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
    GROUP BY c_custkey, c_name ORDER BY revenue DESC, c_custkey LIMIT 25"""


@query(TOP_SQL)
def j1_star_join_top_customers(t: Tables) -> DataFrame:
    orders = t.orders.filter((F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1998-01-01"))
    joined = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_custkey", "c_name").agg(F.count_distinct("o_orderkey").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")).orderBy(F.desc("revenue"), "c_custkey").limit(25)


@query(TOP_SQL)
def j2_comma_join(t: Tables) -> DataFrame:
    for name in ("lineitem", "orders", "customer"):
        getattr(t, name).createOrReplaceTempView(f"of_{name}")
    return t.spark.sql("""SELECT c_custkey, c_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM of_lineitem, of_orders, of_customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND year(o_orderdate) BETWEEN 1996 AND 1997
        GROUP BY c_custkey, c_name ORDER BY revenue DESC, c_custkey LIMIT 25""")


@query("SELECT l_orderkey AS order_id, l_linenumber AS line, l_quantity AS quantity FROM lineitem")
def f1_rename_keep(t: Tables) -> DataFrame:
    return filters.rename_keep(t.lineitem, {"l_orderkey": "order_id", "missing": "x", "l_linenumber": "line", "l_quantity": "quantity"})


@query("SELECT event_id, try_cast(event_type AS DOUBLE) AS event_type, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def f2_coerce(t: Tables) -> DataFrame:
    return filters.coerce(t.events.select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k")), {"event_type": "double", "k": "int"})


@query("""SELECT l_orderkey, l_linenumber, date_diff('second', o_orderdate, l_shipdate)::DOUBLE AS seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def f3_duration(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    micros = F.unix_micros(F.col("l_shipdate").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return joined.select("l_orderkey", "l_linenumber", (micros / 1e6).alias("seconds"))


def _rules() -> list:
    return [
        ("returned", F.col("l_returnflag") != "R", "returns are no sales"),
        ("quantity", F.col("l_quantity").between(2, 48), "outliers of quantity"),
        ("discount", F.col("l_discount") <= 0.08, "clearance"),
        ("price", F.col("l_extendedprice") > 1000, "samples"),
    ]


_FAILS = "CASE WHEN NOT coalesce(l_returnflag <> 'R', false) THEN 1 WHEN NOT coalesce(l_quantity BETWEEN 2 AND 48, false) THEN 2 WHEN NOT coalesce(l_discount <= 0.08, false) THEN 3 WHEN NOT coalesce(l_extendedprice > 1000, false) THEN 4 END"


@query(f"""WITH m AS (SELECT {_FAILS} AS r FROM lineitem), n AS (SELECT r, count(*) AS n FROM m GROUP BY r),
    named(step, rule, why) AS (VALUES (1, 'returned', 'returns are no sales'), (2, 'quantity', 'outliers of quantity'), (3, 'discount', 'clearance'), (4, 'price', 'samples')),
    d AS (SELECT step, rule, why, coalesce(n, 0) AS dropped, (SELECT sum(n) FROM n) AS total FROM named LEFT JOIN n ON step = r)
    SELECT step, rule, why, dropped, (total - sum(dropped) OVER (ORDER BY step))::BIGINT AS remaining, round(100 * dropped / total, 4) AS pct FROM d""")
def f4_audited_filter_log(t: Tables) -> DataFrame:
    return filters.audited_filter(t.lineitem, _rules())[1]


@query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE {_FAILS} IS NULL")
def f4_audited_filter_rows(t: Tables) -> DataFrame:
    return filters.audited_filter(t.lineitem, _rules())[0].select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
def f5_not_null(t: Tables) -> DataFrame:
    return t.labels.na.drop(subset=["doc_id", "quality", "toxic"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.05")
def f6_box(t: Tables) -> DataFrame:
    return t.lineitem.filter(filters.in_box("l_quantity", "l_discount", (10, 20, 0.02, 0.05))).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000")
def f7_range(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_totalprice").between(50_000, 60_000)).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice / l_quantity BETWEEN 900 AND 1500")
def f8_derived_filter(t: Tables) -> DataFrame:
    return t.lineitem.filter((F.col("l_extendedprice") / F.col("l_quantity")).between(900, 1500)).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE NOT coalesce(starts_with(p_name, 'small'), false)")
def f9_prefix(t: Tables) -> DataFrame:
    return t.part.filter(~F.coalesce(F.startswith("p_name", F.lit("small")), F.lit(False))).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')")
def f10_lists(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P")).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'ring') OR contains(p_name, '?') OR contains(p_name, 'red')")
def f11_any_token(t: Tables) -> DataFrame:
    return t.part.filter(filters.any_token("p_name", ["ring", "?", "red"])).select("p_partkey")


@query("SELECT p_partkey, upper(trim(p_name)) AS name FROM part")
def f12_normalise(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.upper(F.trim("p_name")).alias("name"))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_tax, l_discount FROM lineitem")
def f13_exact_rows(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_tax", "l_discount").dropDuplicates()


@query("SELECT l_orderkey, l_suppkey, min(l_linenumber) AS line FROM lineitem GROUP BY l_orderkey, l_suppkey")
def f14_key_dedup(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("line"))


@query("SELECT 'l_discount' AS \"column\", count(*) FILTER (WHERE l_discount < 0.02 OR l_discount > 0.07) AS changed FROM lineitem UNION ALL SELECT 'l_quantity', count(*) FILTER (WHERE l_quantity < 5 OR l_quantity > 45) FROM lineitem")
def f15_clip_ledger(t: Tables) -> DataFrame:
    return filters.clip(t.lineitem, {"l_discount": (0.02, 0.07), "l_quantity": (5.0, 45.0)})[1]


@query("SELECT o_orderkey, coalesce(c_mktsegment, 'none') AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def f16_fill(t: Tables) -> DataFrame:
    rich = t.customer.filter("c_acctbal > 0")
    return t.orders.join(rich, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("none")).alias("segment"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'other' END AS label FROM orders")
def f17_label(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > 300_000, "large").when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("other").alias("label"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 1000 AND contains(lower(c_name), '1') ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 20")
def f18_browse(t: Tables) -> DataFrame:
    found = t.customer.filter((F.col("c_acctbal") >= 1000) & F.contains(F.lower("c_name"), F.lit("1")))
    return found.orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").select("c_custkey", "c_acctbal").offset(20).limit(20)


@query("""SELECT view, count(*) AS n FROM (SELECT unnest([CASE WHEN event_type = 'purchase' THEN 'completed' END, CASE WHEN event_type <> 'purchase' AND ts < TIMESTAMP '2024-01-15' THEN 'overdue' END,
    CASE WHEN event_type <> 'purchase' AND ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16' THEN 'today' END, CASE WHEN event_type <> 'purchase' AND ts >= TIMESTAMP '2024-01-16' THEN 'upcoming' END, 'all']) AS view FROM events) WHERE view IS NOT NULL GROUP BY view""")
def f19_views(t: Tables) -> DataFrame:
    open_ = F.col("event_type") != "purchase"
    views = F.array_compact(F.array(
        F.when(~open_, "completed"), F.when(open_ & (F.col("ts") < "2024-01-15"), "overdue"),
        F.when(open_ & (F.col("ts") >= "2024-01-15") & (F.col("ts") < "2024-01-16"), "today"), F.when(open_ & (F.col("ts") >= "2024-01-16"), "upcoming"), F.lit("all"),
    ))
    return t.events.select(F.explode(views).alias("view")).groupBy("view").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN instr(lower(p_name), 'ring') > 0 THEN 3 - (instr(lower(p_name), 'ring') - 1) / 1000.0 WHEN contains(lower(p_type), 'ring') THEN 2.0 WHEN contains(lower(p_brand), 'ring') THEN 1.0 END::DOUBLE AS score
    FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') OR contains(lower(p_brand), 'ring') ORDER BY score DESC, p_partkey LIMIT 30""")
def f20_search(t: Tables) -> DataFrame:
    scored = t.part.withColumn("tags", F.array("p_brand")).withColumn("score", filters.search_score("ring", "p_name", "p_type", "tags"))
    return scored.filter("score IS NOT NULL").orderBy(F.desc("score"), "p_partkey").select("p_partkey", "score").limit(30)


@query("SELECT event_id FROM events WHERE NOT (event_type = 'error' AND ts < TIMESTAMP '2024-01-20')")
def f21_purge(t: Tables) -> DataFrame:
    return t.events.filter(~((F.col("event_type") == "error") & (F.col("ts") < "2024-01-20"))).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-04-01'")
def f22_half_open(t: Tables) -> DataFrame:
    return t.orders.filter((F.col("o_orderdate") >= "1997-03-01") & (F.col("o_orderdate") < "1997-04-01")).select("o_orderkey")


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 2000000")
def f23_having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("revenue")).filter("revenue > 2000000").select("o_custkey", F.round("revenue", 2).alias("revenue"))


@query("SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) BETWEEN 3 AND 5")
def f24_size_band(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("n")).filter(F.col("n").between(3, 5))


@query("""SELECT count(*) AS all_rows, count(*) FILTER (WHERE quality IS NOT NULL) AS labelled, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS clean,
    count(DISTINCT CASE WHEN quality IS NOT NULL THEN source END) AS labelled_sources FROM documents LEFT JOIN labels USING (doc_id)""")
def f25_nested_cohorts(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return joined.agg(F.count("*").alias("all_rows"), F.count("quality").alias("labelled"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean"), F.count_distinct(F.when(F.col("quality").isNotNull(), F.col("source"))).alias("labelled_sources"))


@query("""SELECT o_custkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate GROUP BY o_custkey""")
def j3_left_range(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")), "left").groupBy("o_custkey").agg(F.count("l_orderkey").alias("lines"))


@query("""WITH a AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS m, round(sum(o_totalprice), 2) AS booked FROM orders GROUP BY 1), b AS (SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS m, round(sum(l_extendedprice), 2) AS shipped FROM lineitem GROUP BY 1)
    SELECT coalesce(a.m, b.m) AS month, coalesce(booked, 0) AS booked, coalesce(shipped, 0) AS shipped FROM a FULL JOIN b ON a.m = b.m""")
def j4_full_outer(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("booked"))
    b = t.lineitem.groupBy(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month")).agg(F.round(F.sum("l_extendedprice"), 2).alias("shipped"))
    return a.join(b, "month", "full_outer").na.fill(0.0)


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def j5_orphans(t: Tables) -> DataFrame:
    return joins.orphans(t.customer.select("c_custkey"), t.orders.filter("o_totalprice > 100000"), "c_custkey", "o_custkey").distinct()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def j6_semi(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part.filter("p_size > 40"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def j7_validated(t: Tables) -> DataFrame:
    nation = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.validated_left_join(t.customer, nation, ["c_nationkey"]).select("c_custkey", "n_name")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'rare' END AS status FROM orders")
def j8_dictionary(t: Tables) -> DataFrame:
    names = F.create_map(F.lit("F"), F.lit("finished"), F.lit("O"), F.lit("open"))
    return t.orders.select("o_orderkey", F.coalesce(F.try_element_at(names, F.col("o_orderstatus")), F.lit("rare")).alias("status"))


@query("""WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT p_brand)) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT l_orderkey AS basket_id, 1 AS set_id FROM s WHERE list_has_all(b, ['Brand#1', 'Brand#2']) UNION ALL SELECT l_orderkey, 2 FROM s WHERE list_has_all(b, ['Brand#3'])""")
def j10_containing(t: Tables) -> DataFrame:
    baskets = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket_id"), F.col("p_brand").alias("item")).distinct()
    sets = t.spark.range(1).select(F.inline(F.array(F.struct(F.lit(1).alias("set_id"), F.array(F.lit("Brand#1"), F.lit("Brand#2")).alias("items")), F.struct(F.lit(2).alias("set_id"), F.array(F.lit("Brand#3")).alias("items")))))
    return joins.containing(sets, baskets)


@query("""SELECT c_custkey, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), '') AS priorities FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def j15_bridge(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS l FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, count(*) AS r FROM customer GROUP BY 1)
    SELECT sum(l)::BIGINT AS left_rows, count(l) AS left_keys, sum(r)::BIGINT AS right_rows, count(r) AS right_keys, coalesce(sum(l * r), 0)::BIGINT AS joined_rows,
    round(sum(l * r) / sum(l), 6) AS fan_out, CASE WHEN sum(l * r) / sum(l) > 10 THEN 'HIGH' WHEN sum(l * r) / sum(l) > 1.5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM a FULL JOIN b ON a.k = b.k""")
def j18_cardinality(t: Tables) -> DataFrame:
    return joins.join_cardinality(t.orders.withColumnRenamed("o_custkey", "k"), t.customer.withColumnRenamed("c_custkey", "k"), ["k"])


@query("""WITH d AS (SELECT o_orderpriority AS p, coalesce(sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1996), 0) AS a, coalesce(sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1997), 0) AS b FROM orders GROUP BY 1)
    SELECT p AS o_orderpriority, round(a, 2) AS "before", round(b, 2) AS "after", round(b - a, 2) AS change, round(100 * (b - a) / a, 4) AS pct, round(100 * (b - a) / (SELECT sum(b - a) FROM d), 4) AS share_of_change FROM d""")
def j20_two_periods(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return A.two_periods(t.orders, "o_orderpriority", "o_totalprice", (d >= "1996-01-01") & (d < "1997-01-01"), (d >= "1997-01-01") & (d < "1998-01-01"))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS m, min(l_quantity) AS lo, max(l_quantity) AS hi, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY 1")
def a1_basic(t: Tables) -> DataFrame:
    q = "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum(q), 2).alias("s"), F.round(F.avg(q), 6).alias("m"), F.min(q).alias("lo"), F.max(q).alias("hi"), F.round(F.stddev_samp(q), 6).alias("sd"))


@query("SELECT l_linestatus, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.01) AS p01, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1")
def a2_quantiles(t: Tables) -> DataFrame:
    found = quantiles(t.lineitem, "l_extendedprice", [0.5, 0.01, 0.99], ["l_linestatus"])
    return found.select("l_linestatus", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("p50", "p01", "p99"))])


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def a3_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"))


@query("SELECT o_custkey, o_orderpriority AS usual FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) WHERE r = 1")
def a4_mode(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return counts.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct(-F.col("n"), "o_orderpriority")).alias("usual"))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY 1")
def a5_first(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n, round(avg(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY 1")
def a6_conditional(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("n"), F.round(F.avg(F.when(F.col("l_tax") > 0.04, 1.0).otherwise(0.0)), 6).alias("share"))


@query("""WITH m AS (SELECT avg(value) AS m FROM events) SELECT round(avg((value - m) ** 3) / avg((value - m) ** 2) ** 1.5, 6) AS skewness, round(avg((value - m) ** 4) / avg((value - m) ** 2) ** 2 - 3, 6) AS kurtosis FROM events, m""")
def a7_moments(t: Tables) -> DataFrame:
    return t.events.agg(F.round(F.skewness("value"), 6).alias("skewness"), F.round(F.kurtosis("value"), 6).alias("kurtosis"))


@query("""WITH b AS (SELECT least(floor((l_quantity - 1) / 4.9), 9)::INTEGER AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1)
    SELECT s.i::INTEGER AS bin, round(1 + s.i * 4.9, 6) AS lower, round(1 + (s.i + 1) * 4.9, 6) AS upper, coalesce(n, 0) AS n FROM range(10) s(i) LEFT JOIN b ON s.i = bin""")
def a8_histogram(t: Tables) -> DataFrame:
    h = A.histogram(t.lineitem, "l_quantity", 10, 1.0, 50.0)
    return h.select("bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n")


@query("SELECT hour(ts)::INTEGER AS hour, " + ", ".join(f"count(*) FILTER (WHERE isodow(ts) - 1 = {d}) AS c_{d}" for d in range(7)) + " FROM events GROUP BY 1")
def a9_crosstab(t: Tables) -> DataFrame:
    return A.crosstab(t.events.select(F.hour("ts").alias("hour"), F.weekday("ts").alias("dow")), "hour", "dow", range(7))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def a11_value_counts(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS items, min(l_shipdate) AS ts FROM lineitem GROUP BY 1")
def a12_baskets(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("items"), F.min("l_shipdate").alias("ts"))


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS))
def a13_pearson(t: Tables) -> DataFrame:
    return A.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", F.round("r", 6))


@query("WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount")) + " FROM lineitem) "
       + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM r" for a, b in _PAIRS))
def a14_spearman(t: Tables) -> DataFrame:
    return A.spearman(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", F.round("r", 6))


@query("WITH c AS (SELECT quantile_cont(o_totalprice, 0.99) AS cut FROM orders) SELECT round(any_value(cut), 4) AS cut, round(sum(o_totalprice) FILTER (WHERE o_totalprice >= cut) / sum(o_totalprice), 6) AS share FROM orders, c")
def a17_concentration(t: Tables) -> DataFrame:
    return A.top_share(t.orders, "o_totalprice", 0.01).withColumn("cut", F.round("cut", 4))


@query("WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), p AS (SELECT n / (SELECT sum(n) FROM n) AS p FROM n) SELECT count(*) AS groups, round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy, round(min(p), 6) AS min_share, round(max(p), 6) AS max_share FROM p")
def a18_entropy(t: Tables) -> DataFrame:
    return A.share_entropy(t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")))


@query("""WITH s AS (SELECT avg(o_totalprice) FILTER (WHERE u) AS a, avg(o_totalprice) FILTER (WHERE NOT u) AS b, var_samp(o_totalprice) FILTER (WHERE u) AS va, var_samp(o_totalprice) FILTER (WHERE NOT u) AS vb, count(*) FILTER (WHERE u) AS na, count(*) FILTER (WHERE NOT u) AS nb
    FROM (SELECT o_totalprice, o_orderpriority = '1-URGENT' AS u FROM orders)) SELECT round((a - b) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS d FROM s""")
def a19_cohens_d(t: Tables) -> DataFrame:
    return t.orders.agg(F.round(A.cohens_d(F.col("o_totalprice"), F.col("o_orderpriority") == "1-URGENT"), 6).alias("d"))


@query("""WITH r AS (SELECT c_mktsegment = 'BUILDING' AS u, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS r FROM customer), s AS (SELECT count(*) FILTER (WHERE u) AS n1, count(*) FILTER (WHERE NOT u) AS n0, sum(r) FILTER (WHERE u) AS r1 FROM r)
    SELECT n1, n0, round(2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n0) - 1, 6) AS delta FROM s""")
def a20_cliffs_delta(t: Tables) -> DataFrame:
    return A.cliffs_delta(t.customer.select("c_acctbal", (F.col("c_mktsegment") == "BUILDING").alias("one")), "c_acctbal", "one")


@query("""WITH l AS (SELECT 'o_orderpriority' AS dimension, o_orderpriority AS level, o_totalprice AS v FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus, o_totalprice FROM orders),
    g AS (SELECT dimension, level, count(*) AS n, sum(v) AS s, sum(v * v) AS q, avg(v) AS m FROM l GROUP BY 1, 2)
    SELECT dimension, round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)), 8) AS eta_squared, arg_max(level, m) AS best, arg_min(level, m) AS worst FROM g GROUP BY 1""")
def a21_eta_squared(t: Tables) -> DataFrame:
    return A.eta_squared(t.orders, ["o_orderpriority", "o_orderstatus"], "o_totalprice")


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def a22_monthly_distinct(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count_distinct("o_custkey").alias("customers"))


@query("SELECT c_mktsegment, round(sum(o_totalprice), 2) AS revenue, round(100 * sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders JOIN customer ON o_custkey = c_custkey), 4) AS pct FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def a23_share_of_total(t: Tables) -> DataFrame:
    by = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.sum("o_totalprice").alias("s"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("s").alias("total")))).select("c_mktsegment", F.round("s", 2).alias("revenue"), F.round(100 * F.col("s") / F.col("total"), 4).alias("pct"))


@query("SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) FILTER (WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-15') AS overdue FROM events GROUP BY 1")
def a24_counters(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if((F.col("event_type") == "error") & (F.col("ts") < "2024-01-15")).alias("overdue"))


@query("SELECT o_orderpriority, o_orderstatus, grouping(o_orderpriority, o_orderstatus)::INTEGER AS g, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), (o_orderpriority, o_orderstatus), ())")
def a25_grouping_sets(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderpriority", "o_orderstatus").agg(F.grouping_id().cast("int").alias("g"), F.count("*").alias("n")).select("o_orderpriority", "o_orderstatus", "g", "n")


_DESCRIBE = "SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS sd, " + ", ".join(f"round(quantile_cont({{c}}, {p / 100}), 5) AS p{p}" for p in (5, 25, 50, 75, 95)) + ", round((SELECT avg(({c} - m) ** 3) / avg(({c} - m) ** 2) ** 1.5 FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)), 5) AS skewness, round(kurtosis_pop({c}), 5) AS kurtosis FROM lineitem"


@query(" UNION ALL ".join(_DESCRIBE.format(c=c) for c in ("l_quantity", "l_extendedprice")))
def a27_described(t: Tables) -> DataFrame:
    out = A.described(t.lineitem, ["l_quantity", "l_extendedprice"])
    return out.select("column", "n", *[F.round(c, 5).alias(c) for c in out.columns[2:]])


@query("SELECT o_orderkey, min(o_orderdate) OVER (PARTITION BY o_custkey) AS first_date FROM orders")
def w1_group_value(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.min("o_orderdate").over(Window.partitionBy("o_custkey")).alias("first_date"))


_DAILY_SQL = "SELECT o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1"


def _daily(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))


@query(f"WITH d AS ({_DAILY_SQL}) SELECT day, round(CASE WHEN lag(v) OVER (ORDER BY day) <> 0 THEN v / lag(v) OVER (ORDER BY day) - 1 END, 8) AS growth FROM d")
def w2_growth(t: Tables) -> DataFrame:
    before = F.lag("v").over(Window.orderBy("day"))  # a row for each day
    return _daily(t).select("day", F.round(F.when(before != 0, F.col("v") / before - 1), 8).alias("growth"))


@query(f"WITH d AS ({_DAILY_SQL}) SELECT day, round(avg(v) OVER (ORDER BY day ROWS 3 PRECEDING), 4) AS mean4 FROM d")
def w3_trailing_mean(t: Tables) -> DataFrame:
    return _daily(t).select("day", F.round(F.avg("v").over(Window.orderBy("day").rowsBetween(-3, 0)), 4).alias("mean4"))


@query(f"WITH d AS ({_DAILY_SQL}) SELECT day, round(CASE WHEN count(v) OVER w >= 3 THEN quantile_cont(v, 0.5) OVER w END, 4) AS median14 FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 6 FOLLOWING)")
def w4_centred_median(t: Tables) -> DataFrame:
    w = Window.orderBy("day").rowsBetween(-7, 6)
    return _daily(t).select("day", F.round(F.when(F.count("v").over(w) >= 3, F.percentile("v", F.lit(0.5)).over(w)), 4).alias("median14"))


@query("WITH r AS (SELECT o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) SELECT o_custkey, date_diff('day', max(o_orderdate) FILTER (WHERE r = 1), max(o_orderdate) FILTER (WHERE r = 2))::INTEGER AS gap FROM r GROUP BY 1")
def w6_first_to_second(t: Tables) -> DataFrame:
    r = t.orders.select("o_custkey", "o_orderdate", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("r"))
    nth = lambda n: F.max(F.when(F.col("r") == n, F.col("o_orderdate")))
    return r.filter("r <= 2").groupBy("o_custkey").agg(F.datediff(nth(2), nth(1)).alias("gap"))


@query("SELECT c_custkey, round((rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2) / count(*) OVER (), 8) AS pct FROM customer")
def w7_percent_rank(t: Tables) -> DataFrame:
    n = t.customer.agg(F.count("*").alias("n"))
    return A.average_rank(t.customer, "c_acctbal", "r").crossJoin(F.broadcast(n)).select("c_custkey", F.round(F.col("r") / F.col("n"), 8).alias("pct"))


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def w9_running_best(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.max("value").over(w).alias("best"))


@query("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, least(floor((sum(n) OVER (ORDER BY n DESC, o_custkey) / (SELECT sum(n) FROM c)) * 10), 9)::INTEGER AS decile FROM c")
def w11_mass_decile(t: Tables) -> DataFrame:
    c = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    upto = running(c, ["-n", "o_custkey"], {"upto": F.col("n")})
    return upto.crossJoin(F.broadcast(c.agg(F.sum("n").alias("total")))).select("o_custkey", F.least(F.floor(F.col("upto") / F.col("total") * 10), F.lit(9)).cast("int").alias("decile"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice <= 100000 THEN 'low' WHEN o_totalprice <= 300000 THEN 'mid' ELSE 'high' END AS band FROM orders")
def w14_fixed_bins(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.when(F.col("o_totalprice") <= 100_000, "low").when(F.col("o_totalprice") <= 300_000, "mid").otherwise("high").alias("band"))


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) * 1024 AS position FROM orders")
def w15_positions(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t.orders.select("o_orderkey", ((place - 1) * 1024).cast("long").alias("position"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def w16_latest(t: Tables) -> DataFrame:
    return filters.latest(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def l2_top_k(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").select("o_orderkey").limit(50)


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def l3_group_top_k(t: Tables) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return t.customer.withColumn("r", r).filter("r <= 3").select("c_nationkey", "c_custkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 40 OFFSET 100")
def l5_page(t: Tables) -> DataFrame:
    return t.orders.orderBy("o_orderdate", "o_orderkey").select("o_orderkey").offset(100).limit(40)


@query()
def l6_sample(t: Tables) -> DataFrame:
    return sampling.sample_n(t.orders, 500, "o_orderkey").select("o_orderkey")


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) WHERE (r - 1) % 10 = 0")
def l8_every_tenth(t: Tables) -> DataFrame:
    return placed(t.customer.select("c_custkey"), ["c_custkey"], "r").filter("(r - 1) % 10 = 0").select("c_custkey")


@query("WITH c AS (SELECT quantile_cont(epoch_us(o_orderdate), 0.8) AS cut FROM orders) SELECT CASE WHEN epoch_us(o_orderdate) > cut THEN 'test' ELSE 'train' END AS split, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders, c GROUP BY 1")
def l9_temporal_split(t: Tables) -> DataFrame:
    return sampling.temporal_split(t.orders, "o_orderdate", 0.2).groupBy("split").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query()
def l10_random_split(t: Tables) -> DataFrame:
    return sampling.random_split(t.orders, 0.2, "o_orderkey").select("o_orderkey", "split")


@query("WITH n AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderpriority, n - round(0.2 * n)::BIGINT AS train, round(0.2 * n)::BIGINT AS test FROM n")
def l11_stratified(t: Tables) -> DataFrame:
    return sampling.stratified_split(t.orders, "o_orderpriority", "o_orderkey", 0.2).groupBy("o_orderpriority").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))


@query()
def l12_folds(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", sampling.fold_of("o_orderkey", 5).alias("fold"))


@query("WITH g AS (SELECT count(DISTINCT o_custkey) AS g FROM orders) SELECT r::INTEGER AS repeat, f::INTEGER AS fold, (g // 6 + CASE WHEN f < g % 6 THEN 1 ELSE 0 END)::BIGINT AS groups FROM g, range(15) a(r), range(6) b(f)")
def l13_group_folds(t: Tables) -> DataFrame:
    return sampling.group_folds(t.orders, "o_custkey", 6, 15).groupBy("repeat", "fold").agg(F.count("*").alias("groups"))


@query()
def l7_weighted_sample(t: Tables) -> DataFrame:
    total = t.orders.agg(F.sum("o_totalprice").alias("total"))
    copies = sampling.weighted_copies(F.col("o_totalprice"), 1000, F.col("total"), "o_orderkey")
    return t.orders.crossJoin(F.broadcast(total)).select("o_orderkey", copies.alias("copies")).filter("copies > 0")


@query("SELECT c_custkey AS k, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def u1_union(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k"), F.lit("c").alias("kind")).unionByName(t.supplier.select(F.col("s_suppkey").alias("k"), F.lit("s").alias("kind")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u2_key_union(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def u3_intersect(t: Tables) -> DataFrame:
    part = lambda f: t.lineitem.filter(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"))
    return part("R").intersect(part("A"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def u4_difference(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").subtract(t.labels.filter("toxic = 1").select("doc_id"))


@query("SELECT 0::BIGINT AS differing")
def u5_equal(t: Tables) -> DataFrame:
    a, b = QUERIES["j1_star_join_top_customers"](t.spark, t.sf_dir), QUERIES["j2_comma_join"](t.spark, t.sf_dir)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("differing"))


@query("SELECT DISTINCT user_id, ts::DATE AS day FROM events")
def u6_distinct(t: Tables) -> DataFrame:
    return t.events.select("user_id", F.to_date("ts").alias("day")).distinct()

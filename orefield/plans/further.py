"""Corpus preparation, rule checks, fitted features and cluster reports."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import measured
from ..operators import clusters as C
from ..operators import evaluation as E
from ..operators import mlfeatures as M
from ..operators import patterns as P
from ..operators import stats
from ..operators import text as K
from .base import Registry, Tables
from .mining import _SETS, SUPPORT, baskets, shown

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _texts(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), "text")


# rules


@query(f"WITH {_SETS} SELECT s.support::DOUBLE AS support, k.k::INTEGER AS longest, (SELECT count(*) FROM sets WHERE count >= ceil(s.support * (SELECT n FROM n)) AND len(items) <= k.k) AS itemsets FROM (VALUES (0.014), (0.0155), (0.1)) s(support), (VALUES (1), (2), (3)) k(k)")
def p21_reused_itemsets(t: Tables) -> DataFrame:
    kept = P.Itemsets(baskets(t), SUPPORT, 3)
    rows = [kept.at(s, k).agg(F.count("*").alias("itemsets")).select(F.lit(s).alias("support"), F.lit(k).alias("longest"), "itemsets") for s in (0.014, 0.0155, 0.1) for k in (1, 2, 3)]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


@query()
def g5_productive_rules(t: Tables) -> DataFrame:
    b = baskets(t)
    sets = P.eclat(b, SUPPORT, 3)
    table = measured(P.rules(sets, b.select("basket_id").distinct().count(), 2), ["lift"])
    return shown(P.productive(table, sets), "n11", F.round("lift", 8).alias("lift"), F.round("worst_p", 8).alias("worst_p"))


@query()
def p19_empirical_fdr(t: Tables) -> DataFrame:
    arrays = baskets(t).groupBy("basket_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return P.empirical_fdr(arrays, [0.95, 1.0, 1.05, 1.1], least=5)


# corpus


@query()
def k5_duplicate_clusters(t: Tables) -> DataFrame:
    return K.near_clusters(_texts(t.documents, "doc_id"))


@query()
def k7_planted_copies(t: Tables) -> DataFrame:
    return K.planted_recall(_texts(t.documents, "doc_id"), 20)


@query()
def k12_preparation_audit(t: Tables) -> DataFrame:
    return K.prepared(_texts(t.documents, "doc_id"), _texts(t.benchmark, "item_id"), 200)[1]


_LONG = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: length(w) >= 5)"
_ASKED = "list_filter(l, lambda w, i: list_position(l, w) = i)[1:3]"


@query(rf"""WITH r AS (SELECT item_id AS id, array_to_string({_ASKED}, ', ') AS asked, text AS reply FROM (SELECT *, {_LONG} AS l FROM benchmark))
    SELECT id, 0 AS turn, 'user' AS role, CASE id % 2 WHEN 0 THEN 'Write a text with these words: ' || asked || '.' ELSE 'Use ' || asked || ' in a text.' END AS text FROM r UNION ALL SELECT id, 1, 'assistant', reply FROM r""")
def k13_conversations(t: Tables) -> DataFrame:
    long = F.array_distinct(F.filter(K.words(F.col("text")), lambda w: F.length(w) >= 5))
    records = t.benchmark.select(F.col("item_id").alias("id"), F.array_join(F.slice(long, 1, 3), ", ").alias("asked"), F.col("text").alias("reply"))
    return K.as_conversations(records, ["Write a text with these words: {}.", "Use {} in a text."])


@query(rf"""WITH q AS (SELECT conv_id, turn, {_ASKED} AS asked FROM (SELECT *, {_LONG} AS l FROM conversations) WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, lower(text) AS reply FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, CASE WHEN len(asked) > 0 THEN round(len(list_filter(asked, lambda w: contains(reply, w))) / len(asked), 8) END AS compliance FROM q JOIN a USING (conv_id, turn)""")
def k15_keyword_compliance(t: Tables) -> DataFrame:
    long = F.array_distinct(F.filter(K.words(F.col("text")), lambda w: F.length(w) >= 5))
    asked = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.slice(long, 1, 3).alias("asked"))
    replies = t.conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return asked.join(replies, ["conv_id", "turn"]).select("conv_id", "turn", F.round(K.compliance(F.col("asked"), F.col("reply")), 8).alias("compliance"))


@query(r"""WITH d AS (SELECT doc_id % 10 = 0 AS held, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS w FROM documents), g AS (SELECT held, unnest(list_transform(range(1, len(w)), lambda i: {'x': w[i], 'y': w[i + 1]})) AS g FROM d), p AS (SELECT held, g.x AS x, g.y AS y, count(*) AS n FROM g GROUP BY 1, 2, 3),
    k AS (SELECT x, y, n FROM p WHERE NOT held), f AS (SELECT x, sum(n) AS n FROM k GROUP BY 1), v AS (SELECT count(DISTINCT w) + 1 AS types FROM (SELECT unnest(w) AS w FROM d WHERE NOT held))
    SELECT round(-sum(a.n * ln((coalesce(k.n, 0) + 1) / (coalesce(f.n, 0) + types))) / sum(a.n), 6) AS nats, sum(a.n)::BIGINT AS bigrams FROM p a LEFT JOIN k ON a.x = k.x AND a.y = k.y LEFT JOIN f ON a.x = f.x, v WHERE a.held""")
def k17_bigram_entropy(t: Tables) -> DataFrame:
    out = K.bigram_entropy(t.documents.filter("doc_id % 10 <> 0"), t.documents.filter("doc_id % 10 = 0"))
    return out.select(F.round("nats", 6).alias("nats"), "bigrams")


def _second(ts: Column) -> Column:
    """Whole seconds since 1970, whatever the session's time zone."""
    return F.unix_date(F.to_date(ts)).cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


# features


@query("""SELECT event_id, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS dow, (isodow(ts) >= 6)::INTEGER AS weekend, round(ln(1 + greatest(coalesce(value, 0), 0)), 8) AS log_value, (value IS NULL)::INTEGER AS value_missing,
    epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events""")
def c1_event_features(t: Tables) -> DataFrame:
    from ..functions.scalars import time_parts

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    parts = time_parts(F.col("ts"))
    df = M.missing_indicators(t.events, ["value"]).withColumn("second", _second(F.col("ts")))
    df = df.withColumn("gap", F.col("second") - F.lag("second").over(w))
    return df.select(
        "event_id", parts["hour"].cast("int").alias("hour"), parts["dow"].cast("int").alias("dow"), (parts["dow"] >= 5).cast("int").alias("weekend"),
        F.round(F.log1p(F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0))), 8).alias("log_value"), "value_missing", "gap",
    )


@query("SELECT doc_id, (quality IS NULL)::INTEGER AS quality_missing, (toxic IS NULL)::INTEGER AS toxic_missing FROM documents LEFT JOIN labels USING (doc_id)")
def c4_missing_indicators(t: Tables) -> DataFrame:
    df = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return M.missing_indicators(df, ["quality", "toxic"]).select("doc_id", "quality_missing", "toxic_missing")


@query("""WITH tr AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'), p AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS i FROM tr GROUP BY 1), s AS (SELECT o_orderstatus AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) AS i FROM tr GROUP BY 1)
    SELECT o_orderkey, coalesce(p.i, (SELECT count(*) + 1 FROM p))::INTEGER AS priority_slot, coalesce(s.i, (SELECT count(*) + 1 FROM s))::INTEGER AS status_slot, o_totalprice AS price FROM orders LEFT JOIN p ON o_orderpriority = p.v LEFT JOIN s ON o_orderstatus = s.v WHERE o_orderdate >= TIMESTAMP '1997-01-01'""")
def c37_replayed_pipeline(t: Tables) -> DataFrame:
    """Fitted on old orders, replayed on new ones; the slots are the places of the ones in each block of the vector."""
    old, new = t.orders.filter("o_orderdate < '1997-01-01'"), t.orders.filter("o_orderdate >= '1997-01-01'")
    model = M.table_pipeline(["o_orderpriority", "o_orderstatus"], ["o_totalprice"]).fit(old)
    n = len(model.stages[0].labelsArray[0]) + 1
    v = vector_to_array("features")
    slot = lambda x: F.array_position(x, F.lit(1.0)).cast("int")
    return model.transform(new).select("o_orderkey", slot(F.slice(v, 1, n)).alias("priority_slot"), slot(F.slice(v, n + 1, F.size(v) - n - 1)).alias("status_slot"), F.element_at(v, -1).alias("price"))


@query()
def a16_eigen_spectrum(t: Tables) -> DataFrame:
    return M.eigen_spectrum(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).withColumns({c: F.round(c, 8) for c in ("eigenvalue", "share", "cumulative")})


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS lowest, max({c})::DOUBLE AS highest FROM lineitem" for c in ("l_quantity", "l_discount", "l_linenumber")))
def c31_reference_statistics(t: Tables) -> DataFrame:
    return M.reference_statistics(t.lineitem, ["l_quantity", "l_discount", "l_linenumber"]).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("""WITH o AS (SELECT o_custkey AS c, (o_orderstatus = 'F')::INTEGER AS y, o_orderkey % 5 AS f FROM orders), s AS (SELECT c, f, sum(y) AS s, count(*) AS n FROM o GROUP BY 1, 2), t AS (SELECT c, sum(s) AS s, sum(n) AS n FROM s GROUP BY 1), p AS (SELECT f, sum(s) AS s, sum(n) AS n FROM s GROUP BY 1),
    e AS (SELECT o.y, t.s / t.n AS i, (t.s - s.s + 10 * ((SELECT sum(s) FROM p) - p.s) / ((SELECT sum(n) FROM p) - p.n)) / (t.n - s.n + 10) AS x FROM o JOIN s ON o.c = s.c AND o.f = s.f JOIN t ON t.c = o.c JOIN p ON p.f = o.f)
    SELECT round(corr(y, i), 6) AS in_fold, round(corr(y, x), 6) AS out_of_fold, round(corr(y, i) - corr(y, x), 6) AS inflation FROM e""")
def c35_encoding_inflation(t: Tables) -> DataFrame:
    df = t.orders.select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_orderkey") % 5).alias("fold"))
    seen = df.groupBy("o_custkey").agg(F.avg("y").alias("seen"))
    out = M.encoding_inflation(E.target_encoding(df, "o_custkey", "y", "fold").join(seen, "o_custkey"), "y", "seen", "encoded")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("SELECT o_orderpriority, count(*) AS n, round(avg(least(o_totalprice / 500000, 1)), 8) AS mean_score, round(avg((o_orderstatus = 'F')::INTEGER), 8) AS rate, round(avg(least(o_totalprice / 500000, 1)) - avg((o_orderstatus = 'F')::INTEGER), 8) AS gap FROM orders GROUP BY 1 HAVING count(*) >= 20")
def c48_calibration_gap(t: Tables) -> DataFrame:
    df = t.orders.select("o_orderpriority", F.least(F.col("o_totalprice") / 500_000, F.lit(1.0)).alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return M.calibration_gap(df, "o_orderpriority", least=20).withColumns({c: F.round(c, 8) for c in ("mean_score", "rate", "gap")})


@query()
def g13_rate_intervals(t: Tables) -> DataFrame:
    df = t.orders.select("o_custkey", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("ok"))
    return stats.rate_intervals(df, "o_custkey", "o_orderpriority", "ok", 100)


@query("SELECT user_id, count(*) AS n, round(regr_slope(value, (epoch_us(ts) // 1000000) / 86400), 6) AS slope FROM events WHERE value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT ts) > 1")
def v3_group_map(t: Tables) -> DataFrame:
    """A fit of one's own for each group of rows, as Arrow tables."""
    import numpy as np
    import pyarrow as pa

    def slope(group: pa.Table) -> pa.Table:
        x, y = group.column("day").to_numpy(), group.column("value").to_numpy()
        x = x - x.mean()
        found = bool((x * x).sum() > 0)
        return pa.table({"user_id": group.column("user_id").slice(0, found), "n": pa.array([len(x)] * found, pa.int64()), "slope": pa.array([round(float((x * (y - y.mean())).sum() / (x * x).sum()), 6)] * found if found else [], pa.float64())})

    rows = t.events.filter("value is not null").select("user_id", (_second(F.col("ts")) / 86_400).alias("day"), "value")
    return rows.groupBy("user_id").applyInArrow(slope, "user_id long, n long, slope double")


# clusters


def _customers(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_mktsegment", (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y"))


_CUSTOMERS = "f AS (SELECT c_custkey, c_mktsegment, c_acctbal / 1000 AS x, c_nationkey::DOUBLE AS y FROM customer)"


@query(f"""WITH {_CUSTOMERS}, d AS (SELECT s.c_custkey AS r, s.c_mktsegment AS own, o.c_mktsegment AS other, avg(sqrt((o.x - s.x) ** 2 + (o.y - s.y) ** 2)) AS d FROM f s JOIN f o ON s.c_custkey <> o.c_custkey WHERE s.c_custkey % 100 = 0 GROUP BY 1, 2, 3),
    p AS (SELECT r, own, max(d) FILTER (WHERE own = other) AS a, min(d) FILTER (WHERE own <> other) AS b FROM d GROUP BY 1, 2), s AS (SELECT own, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM p) SELECT own AS label, count(*) AS n, round(avg(s), 8) AS silhouette, round(avg((s < 0)::INTEGER), 8) AS negative FROM s GROUP BY 1""")
def c16_silhouette_profile(t: Tables) -> DataFrame:
    df = _customers(t)
    out = C.silhouette_profile(df, df.filter("c_custkey % 100 = 0"), "c_custkey", "c_mktsegment", ["x", "y"])
    return out.withColumns({c: F.round(c, 8) for c in ("silhouette", "negative")})


@query()
def c22_hopkins(t: Tables) -> DataFrame:
    return C.hopkins(_customers(t), "c_custkey", ["x", "y"]).select(F.round("hopkins", 6).alias("hopkins"))


_SCORED = f"""{_CUSTOMERS}, c AS (SELECT c_nationkey % 4 AS l, avg(c_acctbal / 1000) AS x, avg(c_nationkey) AS y FROM customer GROUP BY 1), d AS (SELECT c_custkey, l, sqrt((f.x - c.x) ** 2 + (f.y - c.y) ** 2) AS d, row_number() OVER (PARTITION BY c_custkey ORDER BY sqrt((f.x - c.x) ** 2 + (f.y - c.y) ** 2), l) AS r FROM f, c),
    s AS (SELECT a.c_custkey, a.l::BIGINT AS segment, CASE WHEN b.d > 0 THEN 1 - a.d / b.d ELSE 0 END AS margin FROM d a JOIN d b ON a.c_custkey = b.c_custkey AND a.r = 1 AND b.r = 2)"""


def _scored(t: Tables) -> DataFrame:
    df = _customers(t).withColumn("l", (F.col("y") % 4).cast("long"))
    return C.scored_segments(df, df.groupBy("l").agg(F.avg("x").alias("x"), F.avg("y").alias("y")), "c_custkey", "l", ["x", "y"])


@query(f"WITH {_SCORED} SELECT c_custkey, segment, round(margin, 6) AS margin, margin < 0.1 AS boundary FROM s")
def c28_scored_segments(t: Tables) -> DataFrame:
    return _scored(t).withColumn("margin", F.round("margin", 6))


@query(f"WITH {_SCORED} SELECT segment, count(*) AS n, count(*) FILTER (WHERE margin < 0.1) AS on_boundary FROM s GROUP BY 1")
def c27_boundary_rows(t: Tables) -> DataFrame:
    return _scored(t).groupBy("segment").agg(F.count("*").alias("n"), F.count_if("boundary").alias("on_boundary"))

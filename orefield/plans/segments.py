"""Segment searches, personas, zones; corrections, splits, citations, reading grades and logs."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import business as B
from ..operators import clusters as C
from ..operators import filters
from ..operators import models as M
from ..operators import patterns as P
from ..operators import retrieval as R
from ..operators import segments as S
from ..operators import stats
from ..operators import text as K
from ..operators.evaluation import regression_scores
from ..operators.sampling import fold_of
from .base import Registry, Tables
from .corpus import _BM25, _NORM, places
from .mining import _FISHER, _HB, _RULES, _TRAINED, baskets, pair_rules, shown, tested
from .modelling import lines

query = Registry()
QUERIES, SQL = query.queries, query.sql
CANDIDATES = [("kmeans", 3, 2), ("kmeans", 4, 3), ("bisecting", 4, 3)]


def customers(t: Tables) -> DataFrame:
    """o_custkey and its logged recency, frequency and monetary value."""
    rfm = B.rfm(t.orders, "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return rfm.select("o_custkey", *[F.log1p(c).alias(c) for c in ("recency", "frequency", "monetary")])


def judged(t: Tables) -> DataFrame:
    rows = customers(t)
    return S.reference_space(rows, ["recency", "frequency", "monetary"]).transform(rows).select("o_custkey", "reference")


def features(t: Tables) -> DataFrame:
    return judged(t).withColumnRenamed("reference", "features")


# segments


@query()
def b8_rfm_segments(t: Tables) -> DataFrame:
    return C.sweep(features(t), [3, 4, 5])


@query()
def c17_c23_search(t: Tables) -> DataFrame:
    table = S.trials(judged(t), CANDIDATES)
    return S.anytime(S.objective(table, S.frozen_scale(table)))


@query()
def c57_optimism(t: Tables) -> DataFrame:
    return S.optimism(S.trials(judged(t), CANDIDATES))


@query()
def c58_finalists(t: Tables) -> DataFrame:
    return S.finalists(judged(t), "o_custkey", CANDIDATES, 2)


@query()
def c56_outlier_sensitivity(t: Tables) -> DataFrame:
    rows = VectorAssembler(inputCols=["recency", "frequency", "monetary"], outputCol="raw").transform(customers(t))
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows).transform(rows)
    return S.outlier_sensitivity(scaled.select("o_custkey", "frequency", "features"), "o_custkey", F.col("frequency") < 2.0, 4)


@query()
def c26_surrogate_leaves(t: Tables) -> DataFrame:
    rows = features(t)
    return S.tree_leaves(C.build("kmeans", 4).fit(rows).transform(rows).select("features", "prediction").withColumnRenamed("prediction", "segment_id"), "segment_id")


@query()
def c25_personas(t: Tables) -> DataFrame:
    orders = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spend"))
    rows = t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_mktsegment", F.col("c_acctbal").alias("balance"), F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("spend", F.lit(0.0)).alias("spend"))
    names = ["balance", "orders", "spend"]
    whole = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_samp(c).alias(f"s_{c}") for c in names])
    axes = rows.groupBy("c_mktsegment").agg(*[F.avg(c).alias(c) for c in names]).crossJoin(F.broadcast(whole)).select("c_mktsegment", *[F.round((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"), 9).alias(c) for c in names])
    kinds = {"big spender": F.col("spend"), "frequent": F.col("orders") - F.col("spend") / 2, "saver": F.col("balance") - F.col("spend")}
    return S.personas(axes, "c_mktsegment", names, kinds).withColumn("fit", F.round("fit", 8))


@query()
def c8_zones(t: Tables) -> DataFrame:
    return S.zones(places(t), ["a", "b"], ["c", "d"], 6).select("c_custkey", "start_zone", "end_zone", "same_zone")


@query()
def c50_search_table(t: Tables) -> DataFrame:
    """Ridge penalties by three folds; the stronger the penalty the smaller the model."""
    rows, out = lines(t).withColumn("fold", fold_of("l_orderkey", 3)).persist(), None
    for number, penalty in enumerate((0.0, 0.01, 1.0)):
        scores = M.cross_validated(rows, LinearRegression(regParam=penalty), "fold", 3, lambda p: regression_scores(p, "label", "prediction").first().r2)
        scores = scores.select(F.lit(number).alias("config"), F.lit(-penalty).alias("size"), "score")
        out = scores if out is None else out.unionByName(scores)
    return S.chosen_within_one_error(out, "config", "size")


# rules


@query(f"WITH {_RULES}, p AS (SELECT a, c, round({_FISHER}, 9) AS p FROM r), k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM p) SELECT a, c, 'none' AS method, round(p, 6) AS q FROM p UNION ALL SELECT a, c, 'bonferroni', round(least(1, p * n), 6) FROM k UNION ALL SELECT a, c, 'bh', round(least(1, min(p * n / k) OVER (ORDER BY k DESC)), 6) FROM k")
def g4_corrections(t: Tables) -> DataFrame:
    table = shown(tested(t), F.round("p", 9).alias("p")).persist()
    parts = [stats.corrected(table, "p", m).select("a", "c", F.lit(m).alias("method"), F.round("q", 6).alias("q")) for m in ("none", "bonferroni", "bh")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {_TRAINED}, {_HB} SELECT r.a, r.c, r.n11, coalesce(h2.n, 0) AS h11, round(coalesce(h2.n, 0) / x.n, 8) AS h_confidence FROM r LEFT JOIN h2 ON r.a = h2.a AND r.c = h2.c LEFT JOIN h1 x ON x.i = r.a")
def p14_holdout_columns(t: Tables) -> DataFrame:
    rules = pair_rules(t, 0)
    report = P.holdout(rules, baskets(t).filter("basket_id % 2 = 1"))
    return shown(P.attached(rules, report, ["h11", "h_confidence"]), "n11", "h11", F.round("h_confidence", 8).alias("h_confidence"))


# filters and logs


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def f22_known_domain(t: Tables) -> DataFrame:
    return t.orders.filter(filters.valid({"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]}, {"o_orderdate": ("1996-01-01", "1998-01-01")})).select("o_orderkey")


@query("""WITH s AS (SELECT user_id, coalesce(arg_max(event_type = 'error', {'t': ts, 'i': event_id}) FILTER (WHERE event_type IN ('error', 'signup')), false) AS gone, coalesce(arg_max(event_type = 'purchase', {'t': ts, 'i': event_id}) FILTER (WHERE event_type IN ('purchase', 'view')), false) AS done FROM events GROUP BY 1)
    SELECT user_id, gone OR done AS deleted, done, done AND NOT gone AS cleared FROM s""")
def b29_soft_delete(t: Tables) -> DataFrame:
    state = B.soft_state(t.events, "user_id", ["ts", "event_id"], "event_type", ["error"], ["signup"], ["purchase"], ["view"])
    return B.clear_completed(state)


# texts


@query(rf"""WITH n AS (SELECT doc_id AS id, string_split({_NORM}, ' ') AS w FROM documents), s AS (SELECT id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM n), c AS (SELECT min(id) AS id, s, id % 10 = 0 AS held FROM s GROUP BY s, id % 10 = 0),
    g AS (SELECT id, held, len(s) AS n, unnest(s) AS g FROM c), p AS (SELECT a.id AS a, b.id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM g a JOIN g b ON a.g = b.g WHERE NOT a.held AND b.held GROUP BY 1, 2) SELECT a, b, round(j, 8) AS similarity FROM p WHERE j >= 0.8""")
def j14_split_bands(t: Tables) -> DataFrame:
    """Near pairs between the training and the validation side; one pair for each two classes of equal texts."""
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    return K.near_pairs(docs.filter("id % 10 <> 0"), docs.filter("id % 10 = 0")).withColumn("similarity", F.round("similarity", 8))


@query(r"""WITH w AS (SELECT list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT len(w) AS n, list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) AS g FROM w), u AS (SELECT unnest(w) AS t FROM w)
    SELECT sum(len(g))::BIGINT AS grams, round(sum(len(g) - len(list_distinct(g))) / sum(len(g)), 8) AS repeated, round(avg(n), 8) AS mean_words, round((SELECT count(DISTINCT t) / count(*) FROM u), 8) AS type_token_ratio FROM g""")
def a28_repetition(t: Tables) -> DataFrame:
    return K.repetition(t.documents).select("grams", *[F.round(c, 8).alias(c) for c in ("repeated", "mean_words", "type_token_ratio")])


@query()
def x35_reading_grade(t: Tables) -> DataFrame:
    g = t.documents.select("doc_id", X.reading_grade(F.col("text")).alias("g")).filter("g IS NOT NULL")
    return g.select("doc_id", *[F.col(f"g.{c}").cast("long").alias(c) for c in ("sentences", "words", "syllables")], F.round("g.ease", 6).alias("ease"), F.round("g.grade", 6).alias("grade"))


@query(r"""WITH p AS (SELECT doc_id, string_split_regex(chr(10) || text, '\n#+') AS p FROM documents), q AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM p), s AS (SELECT doc_id, CASE WHEN i = 1 THEN '(preamble)' ELSE trim(split_part(p, chr(10), 1)) END AS section, list_filter(regexp_split_to_array(CASE WHEN i = 1 THEN p ELSE substr(p, length(split_part(p, chr(10), 1)) + 2) END, '\s+'), lambda x: x <> '') AS w FROM q),
    c AS (SELECT doc_id, section, w, unnest(range(0, greatest(len(w), 1), 136)) AS pos FROM s) SELECT doc_id, doc_id || '#' || section || '#' || (pos // 136) AS id, section, md5(section || '. ' || array_to_string(w[pos + 1:pos + 160], ' ')) AS digest FROM c WHERE len(w[pos + 1:pos + 160]) >= 20 AND (pos = 0 OR pos + 24 < len(w))""")
def r5_cited_chunks(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.inline(X.cited_chunks(F.col("doc_id"), F.col("text")))).select("doc_id", "id", "section", F.md5("text").alias("digest"))


@query(f"WITH {_BM25}, o AS (SELECT query_id, doc_id, count(*) AS shared FROM q JOIN i USING (term) GROUP BY 1, 2), orank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, doc_id) AS rank FROM o), u AS (SELECT query_id, doc_id, rank FROM bm WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank FROM orank WHERE rank <= 20), f AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 12) AS score FROM u GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) SELECT query_id, doc_id, round(score, 9) AS score, rank::INTEGER AS rank FROM w WHERE rank <= 10")
def r3_two_rankings(t: Tables) -> DataFrame:
    """BM25 and the share of a query's different terms, fused."""
    docs, queries = t.documents.select("doc_id", "text"), t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    found = R.postings(docs, queries)
    return R.fused([R.bm25(docs, queries, 20, found=found), R.overlap(docs, queries, 20, found)], 10).withColumn("score", F.round("score", 9))

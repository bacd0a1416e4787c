"""Market baskets: brands per order. Itemsets, rules, measures, tests, holdout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import MEASURES, measured
from ..functions.special import fisher_right
from ..operators import patterns as P
from ..operators import stats
from .base import Registry, Tables

query = Registry()
QUERIES, SQL = query.queries, query.sql
SUPPORT = 0.014
#: What a rule must reach in other baskets, and the share of false findings allowed there.
CONFIDENCE, LIFT, ALPHA = 0.1, 1.0, 0.05

_B = "b AS (SELECT DISTINCT l_orderkey AS k, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey)"
_SETS = f"""{_B}, n AS (SELECT count(DISTINCT k) AS n FROM b), least AS (SELECT ceil({SUPPORT} * n) AS c FROM n),
    s1 AS (SELECT [i] AS items, count(*) AS count FROM b GROUP BY i),
    s2 AS (SELECT [x.i, y.i] AS items, count(*) AS count FROM b x JOIN b y ON x.k = y.k AND x.i < y.i GROUP BY x.i, y.i),
    s3 AS (SELECT [x.i, y.i, z.i] AS items, count(*) AS count FROM b x JOIN b y ON x.k = y.k AND x.i < y.i JOIN b z ON x.k = z.k AND y.i < z.i GROUP BY x.i, y.i, z.i),
    sets AS (SELECT * FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) WHERE count >= (SELECT c FROM least))"""
_SETS_SQL = f"WITH {_SETS} SELECT array_to_string(items, ',') AS items, count FROM sets"
_RULES = f"""{_SETS}, r AS (SELECT x.i AS a, y.i AS c, s.count AS n11, sa.count AS n1, sc.count AS m1, n.n FROM sets s, n, (SELECT DISTINCT i FROM b) x, (SELECT DISTINCT i FROM b) y, sets sa, sets sc
    WHERE len(s.items) = 2 AND list_contains(s.items, x.i) AND list_contains(s.items, y.i) AND x.i <> y.i AND sa.items = [x.i] AND sc.items = [y.i])"""


def baskets(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket_id"), F.col("p_brand").alias("item")).distinct()


def pair_rules(t: Tables, half: int | None = None) -> DataFrame:
    """Rules of one item each from the pairs, with counts; of all baskets, or of those whose number modulo 2 is half."""
    b = baskets(t) if half is None else baskets(t).filter(F.col("basket_id") % 2 == half)
    mined = P.Itemsets(b, SUPPORT, 2)
    return P.rules(mined.kept, mined.n, 1)


def shown(rules: DataFrame, *columns: str) -> DataFrame:
    return rules.select(F.array_join("antecedent", ",").alias("a"), F.array_join("consequent", ",").alias("c"), *columns)


def _joined(sets: DataFrame) -> DataFrame:
    return sets.select(F.array_join("items", ",").alias("items"), "count")


@query(f"WITH {_B} SELECT i AS item, count(*) AS count FROM b GROUP BY i HAVING count(*) >= (SELECT ceil(0.15 * count(DISTINCT k)) FROM b)")
def p1_item_floor(t: Tables) -> DataFrame:
    b = baskets(t)
    return P.frequent_items(b, P.least_count(b, 0.15))


@query(f"WITH {_B} SELECT i AS item, count(*) AS count, (row_number() OVER (ORDER BY count(*) DESC, i) - 1)::INTEGER AS code FROM b GROUP BY i")
def p2_item_codes(t: Tables) -> DataFrame:
    return P.item_codes(baskets(t))


@query(f"WITH {_B}, f AS (SELECT i FROM b GROUP BY i HAVING count(*) >= (SELECT ceil(0.15 * count(DISTINCT k)) FROM b)), g AS (SELECT l_orderkey AS basket_id, min(l_shipdate) AS ts, list_sort(list(DISTINCT p_brand)) AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN (SELECT i FROM f) GROUP BY 1) SELECT basket_id, ts, array_to_string(s, ',') AS items FROM g WHERE len(s) BETWEEN 2 AND 6")
def p3_baskets(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket_id"), F.col("p_brand").alias("item"), F.col("l_shipdate").alias("ts"))
    return P.build_baskets(lines, P.least_count(lines, 0.15), 2, 6).select("basket_id", "ts", F.array_join("items", ",").alias("items"))


@query(_SETS_SQL)
def p4_fpgrowth(t: Tables) -> DataFrame:
    return _joined(P.fpgrowth(baskets(t), SUPPORT, 3))


@query(_SETS_SQL)
def p5_apriori(t: Tables) -> DataFrame:
    return _joined(P.apriori(baskets(t), SUPPORT, 3))


@query(_SETS_SQL)
def p6_eclat(t: Tables) -> DataFrame:
    return _joined(P.eclat(baskets(t), SUPPORT, 3))


@query(_SETS_SQL)
def p6_vertical(t: Tables) -> DataFrame:
    return _joined(P.vertical(baskets(t), SUPPORT, 3))


@query(f"WITH {_SETS} SELECT len(items)::INTEGER AS k, count(*) AS itemsets FROM sets GROUP BY 1")
def p8_levels(t: Tables) -> DataFrame:
    return P.eclat(baskets(t), SUPPORT, 3).groupBy(F.size("items").alias("k")).agg(F.count("*").alias("itemsets"))


@query(f"WITH {_RULES} SELECT a, c, n11, n1, m1, n FROM r")
def p9_rules(t: Tables) -> DataFrame:
    return shown(pair_rules(t), "n11", "n1", "m1", "n")


@query(f"WITH {_RULES}, m AS (SELECT a, c, n11 / n1 AS confidence, n11 * n / (n1 * m1) AS lift, n11 / n - n1 / n * m1 / n AS leverage FROM r), k AS (SELECT * FROM m WHERE confidence >= 0.1 AND lift >= 0.9 ORDER BY round(leverage, 12) DESC, round(lift, 12) DESC, a, c LIMIT 40) SELECT printf('R%05d', row_number() OVER (ORDER BY round(leverage, 12) DESC, round(lift, 12) DESC, a, c) - 1) AS rule_id, a, c, round(lift, 8) AS lift FROM k")
def p11_ranked(t: Tables) -> DataFrame:
    table = measured(pair_rules(t), ["confidence", "lift", "leverage"])
    table = table.withColumns({m: F.round(m, 12) for m in ("lift", "leverage")})
    return shown(P.ranked(table, 40, confidence=0.1, lift=0.9), "rule_id", F.round("lift", 8).alias("lift"))


_M = {
    "support": "p", "antecedent_support": "pa", "consequent_support": "pb", "confidence": "conf", "lift": "p / (pa * pb)", "leverage": "p - pa * pb",
    "conviction": "CASE WHEN abs(1 - conf) > 1e-12 THEN (1 - pb) / (1 - conf) ELSE 1e9 END", "cosine": "p / sqrt(pa * pb)", "jaccard": "p / (pa + pb - p)",
    "all_confidence": "p / greatest(pa, pb)", "max_confidence": "greatest(x / r1, x / c1)", "kulczynski": "0.5 * (x / r1 + x / c1)", "imbalance_ratio": "abs(pa - pb) / (pa + pb - p)",
    "added_value": "conf - pb", "certainty_factor": "(conf - pb) / (1 - pb)", "laplace": "(x + 1) / (r1 + 2)", "klosgen": "sqrt(p) * (conf - pb)",
    "zhang": "(p - pa * pb) / greatest(p * (1 - pb), pb * (pa - p))", "phi": "(x * w - y * z) / sqrt(r1 * c1 * (n - r1) * (n - c1))", "odds_ratio": "x * w / (y * z)",
    "yule_q": "(x * w - y * z) / (x * w + y * z)", "yule_y": "(sqrt(x * w) - sqrt(y * z)) / (sqrt(x * w) + sqrt(y * z))", "kappa": "((x + w) / n - pe) / (1 - pe)",
    "chi_square": "n * (x * w - y * z) ** 2 / (r1 * c1 * (n - r1) * (n - c1))",
    "mutual_information": "(x / n * ln(x * n / (r1 * c1)) + y / n * ln(y * n / (r1 * (n - c1))) + z / n * ln(z * n / ((n - r1) * c1)) + w / n * ln(w * n / ((n - r1) * (n - c1)))) / least(-pa * ln(pa) - (1 - pa) * ln(1 - pa), -pb * ln(pb) - (1 - pb) * ln(1 - pb))",
    "j_measure": "pa * (conf * ln(conf / pb) + (1 - conf) * ln((1 - conf) / (1 - pb)))",
    "gini": "pa * (conf ** 2 + (1 - conf) ** 2) + (1 - pa) * ((z / (n - r1)) ** 2 + (1 - z / (n - r1)) ** 2) - pb ** 2 - (1 - pb) ** 2",
    "collective_strength": "((x + w) / n) / pe * (1 - pe) / (1 - (x + w) / n)",
    "goodman_kruskal": "(greatest(x, y) + greatest(z, w) + greatest(x, z) + greatest(y, w) - greatest(c1, n - c1) - greatest(r1, n - r1)) / (2 * n - greatest(c1, n - c1) - greatest(r1, n - r1))",
    "two_way_support": "p * ln(p / (pa * pb))", "sebag_schoenauer": "x / y", "count": "x",
}


@query(f"""WITH {_RULES}, d AS (SELECT a, c, n11::DOUBLE AS x, (n1 - n11)::DOUBLE AS y, (m1 - n11)::DOUBLE AS z, (n - n1 - m1 + n11)::DOUBLE AS w, n1::DOUBLE AS r1, m1::DOUBLE AS c1, n::DOUBLE AS n FROM r),
    e AS (SELECT *, x / n AS p, r1 / n AS pa, c1 / n AS pb, x / r1 AS conf, r1 / n * c1 / n + (1 - r1 / n) * (1 - c1 / n) AS pe FROM d)
    SELECT a, c, {', '.join(f'round({e}, 6) AS {m}' for m, e in _M.items())} FROM e""")
def m1_to_m32_measures(t: Tables) -> DataFrame:
    return shown(measured(pair_rules(t)), *[F.round(m, 6).alias(m) for m in MEASURES])


_FISHER = "least(1, list_sum(list_transform(range(n11, least(n1, m1) + 1), lambda x: exp(lgamma(n1 + 1) - lgamma(x + 1) - lgamma(n1 - x + 1) + lgamma(n - n1 + 1) - lgamma(m1 - x + 1) - lgamma(n - n1 - m1 + x + 1) - lgamma(n + 1) + lgamma(m1 + 1) + lgamma(n - m1 + 1)))))"


def tested(t: Tables) -> DataFrame:
    return pair_rules(t).withColumn("p", fisher_right(F.col("n11"), F.col("n1"), F.col("m1"), F.col("n")))


@query(f"WITH {_RULES} SELECT a, c, round({_FISHER}, 6) AS p FROM r")
def g1_fisher(t: Tables) -> DataFrame:
    return shown(tested(t), F.round("p", 6).alias("p"))


@query(f"WITH {_RULES}, p AS (SELECT a, c, round({_FISHER}, 9) AS p FROM r), k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM p) SELECT a, c, round(least(1, min(p * n / k) OVER (ORDER BY k DESC)), 6) AS q FROM k")
def g2_benjamini_hochberg(t: Tables) -> DataFrame:
    return shown(stats.corrected(tested(t).withColumn("p", F.round("p", 9)), "p", "bh"), F.round("q", 6).alias("q"))


@query(f"WITH {_RULES}, p AS (SELECT a, c, {_FISHER} AS p FROM r) SELECT a, c, round(least(1, p * (SELECT count(*) FROM p)), 6) AS q FROM p")
def g3_bonferroni(t: Tables) -> DataFrame:
    return shown(stats.corrected(tested(t), "p", "bonferroni"), F.round("q", 6).alias("q"))


@query(f"WITH {_RULES}, p AS (SELECT {_FISHER} AS p FROM r) SELECT count(*) AS tests, count(*) FILTER (WHERE p <= 0.05) AS raw, count(*) FILTER (WHERE p * (SELECT count(*) FROM p) <= 0.05) AS bonferroni FROM p")
def g7_summary(t: Tables) -> DataFrame:
    return stats.corrected(tested(t), "p", "bonferroni").agg(F.count("*").alias("tests"), F.count_if(F.col("p") <= 0.05).alias("raw"), F.count_if(F.col("q") <= 0.05).alias("bonferroni"))


#: Rules of the baskets with even numbers, and counts in those with odd ones.
_TRAINED = _RULES.replace(" ON l_partkey = p_partkey)", " ON l_partkey = p_partkey WHERE l_orderkey % 2 = 0)", 1)
_HB = """ht AS (SELECT DISTINCT l_orderkey AS k, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 2 = 1), hn AS (SELECT count(DISTINCT k) AS n FROM ht),
    h1 AS (SELECT i, count(*) AS n FROM ht GROUP BY i), h2 AS (SELECT x.i AS a, y.i AS c, count(*) AS n FROM ht x JOIN ht y ON x.k = y.k AND x.i <> y.i GROUP BY 1, 2)"""
_REPLICATED = f"""WITH {_TRAINED}, {_HB}, h AS (SELECT r.a, r.c, r.n11 / r.n1 AS confidence, round(r.n11 * r.n / (r.n1 * r.m1), 12) AS lift, coalesce(h2.n, 0) AS n11, coalesce(x.n, 0) AS n1, coalesce(y.n, 0) AS m1, hn.n AS n
        FROM hn, r LEFT JOIN h2 ON r.a = h2.a AND r.c = h2.c LEFT JOIN h1 x ON x.i = r.a LEFT JOIN h1 y ON y.i = r.c),
    p AS (SELECT *, n11 / n1 AS h_confidence, round(n11 * n / (n1 * m1), 12) AS h_lift, round({_FISHER}, 9) AS h_p FROM h), k AS (SELECT *, row_number() OVER (ORDER BY h_p) AS k, count(*) OVER () AS tests FROM p),
    q AS (SELECT *, least(1, min(h_p * tests / k) OVER (ORDER BY h_p DESC)) AS h_q FROM k), v AS (SELECT *, n11 >= 5 AND h_confidence >= {CONFIDENCE} AND h_lift >= {LIFT} AS replicated FROM q),
    judged AS (SELECT *, replicated AND h_q <= {ALPHA} AS validated FROM v)"""


def judged(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Rules mined from half of the baskets and judged in the other half; those baskets."""
    odd = baskets(t).filter("basket_id % 2 = 1")
    rules = measured(pair_rules(t, 0), ["confidence", "lift"])
    held = P.holdout(rules, odd).withColumn("h_lift", F.round("h_lift", 12))
    return P.replicated(held, CONFIDENCE, LIFT, alpha=ALPHA), odd


@query(f"{_REPLICATED} SELECT a, c, n11 AS h11, n1 AS h1, m1 AS hm1, n AS hn, round(h_confidence, 8) AS h_confidence, round(h_lift, 8) AS h_lift, round(h_p, 6) AS h_p, round(h_q, 5) AS h_q, replicated, validated FROM judged")
def p13_holdout(t: Tables) -> DataFrame:
    found = judged(t)[0]
    return shown(found, "h11", "h1", "hm1", "hn", *[F.round(c, d).alias(c) for c, d in (("h_confidence", 8), ("h_lift", 8), ("h_p", 6), ("h_q", 5))], "replicated", "validated")


@query(f"""{_REPLICATED}, fired AS (SELECT count(DISTINCT ht.k) AS n FROM ht JOIN judged ON ht.i = judged.a),
    lr AS (SELECT rank() OVER (ORDER BY lift) + (count(*) OVER (PARTITION BY lift) - 1) / 2 AS x, rank() OVER (ORDER BY h_lift) + (count(*) OVER (PARTITION BY h_lift) - 1) / 2 AS y FROM judged)
    SELECT count(*) AS n_rules, max(n) AS n_baskets, count(*) FILTER (WHERE n11 >= 5) AS n_with_least, count(*) FILTER (WHERE replicated) AS n_replicated, round(avg(replicated::INT), 8) AS replication_rate,
        count(*) FILTER (WHERE validated) AS n_validated, round(avg(validated::INT), 8) AS validated_rate, round((SELECT n FROM fired) / max(n), 8) AS coverage, round(sum(n11) / sum(n1), 8) AS firing_precision,
        round((SELECT corr(x, y) FROM lr), 8) AS lift_rank_spearman, round(avg(h_confidence - confidence), 8) AS confidence_drift_mean, round(avg(abs(h_confidence - confidence)), 8) AS confidence_drift_mae,
        round(avg(h_lift - lift), 8) AS lift_drift_mean, round(quantile_cont(h_p, 0.5), 6) AS median_h_p FROM judged""")
def p13_report(t: Tables) -> DataFrame:
    found, odd = judged(t)
    out = P.holdout_report(found, odd)
    return out.select(*[F.round(c, 6 if c == "median_h_p" else 8).alias(c) if kind == "double" else c for c, kind in out.dtypes])


@query(f"""WITH {_RULES}, m AS (SELECT a, c, round(n11 / n1, 10) AS conf FROM r WHERE n11 * n / (n1 * m1) >= 0.9), o AS (SELECT b.k AS basket_id, m.c AS item, max(conf) AS confidence FROM b JOIN m ON b.i = m.a ANTI JOIN b x ON x.k = b.k AND x.i = m.c GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY confidence DESC, item) AS place FROM o) SELECT basket_id, item, confidence, place::INTEGER AS place FROM p WHERE place <= 3""".replace("ANTI JOIN b x ON x.k = b.k AND x.i = m.c", "WHERE NOT EXISTS (SELECT 1 FROM b x WHERE x.k = b.k AND x.i = m.c)"))
def p15_recommend(t: Tables) -> DataFrame:
    table = measured(pair_rules(t), ["confidence", "lift"]).filter("lift >= 0.9").withColumn("confidence", F.round("confidence", 10))
    return P.recommend(table, baskets(t), 3).select("basket_id", "item", "confidence", "place")


@query(f"WITH {_RULES} SELECT x.c::DOUBLE AS confidence, y.l::DOUBLE AS lift, (SELECT count(*) FROM r WHERE n11 / n1 >= x.c AND n11 * n / (n1 * m1) >= y.l) AS rules FROM (VALUES (0.1), (0.12), (0.15)) x(c), (VALUES (0.8), (0.95), (1.1)) y(l)")
def p16_sensitivity(t: Tables) -> DataFrame:
    return P.sensitivity(measured(pair_rules(t), ["confidence", "lift"]), [0.1, 0.12, 0.15], [0.8, 0.95, 1.1])


@query(f"WITH {_RULES} SELECT a AS source, c AS target, count(*) AS rules, round(least(max(n11 * n / (n1 * m1)), 25), 8) AS lift FROM r GROUP BY 1, 2")
def p18_network(t: Tables) -> DataFrame:
    return P.network(measured(pair_rules(t), ["lift"]))[1].withColumn("lift", F.round("lift", 8))


@query("SELECT p_brand AS item, count(DISTINCT l_orderkey) AS count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def p19_swap_null_margins(t: Tables) -> DataFrame:
    """Item counts after swapping, which must be those before."""
    arrays = baskets(t).groupBy("basket_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return P.swap_null(arrays, 3).select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("count"))


@query("""WITH a AS (SELECT event_type = 'purchase' AS ok, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS arm FROM events), s AS (SELECT count(*) FILTER (WHERE arm = 'A') AS n0, count(*) FILTER (WHERE arm = 'B') AS n1, avg(ok::INT) FILTER (WHERE arm = 'A') AS p0, avg(ok::INT) FILTER (WHERE arm = 'B') AS p1 FROM a),
    q AS (SELECT *, (p0 * n0 + p1 * n1) / (n0 + n1) AS p, sqrt(p0 * (1 - p0) / n0 + p1 * (1 - p1) / n1) AS own FROM s)
    SELECT n0, n1, round(p0, 8) AS p0, round(p1, 8) AS p1, round((p1 - p0) / p0, 8) AS lift, round((p1 - p0) / sqrt(p * (1 - p) * (1 / n0 + 1 / n1)), 6) AS z, round(p1 - p0 - 1.959964 * own, 8) AS low, round(p1 - p0 + 1.959964 * own, 8) AS high FROM q""")
def g9_two_proportions(t: Tables) -> DataFrame:
    arms = t.events.select((F.col("event_type") == "purchase").cast("int").alias("ok"), F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("arm"))
    out = stats.two_proportions(arms, "arm", "ok", "A", "B")
    return out.select("n0", "n1", *[F.round(c, 6 if c == "z" else 8).alias(c) for c in out.columns[2:]])


@query()
def g8_sample_ratio(t: Tables) -> DataFrame:
    return stats.sample_ratio(t.events.withColumn("arm", F.when(F.col("user_id") % 2 == 0, "A").otherwise("B")), "arm", "A", "B")


@query()
def g10_group_bootstrap(t: Tables) -> DataFrame:
    reps = stats.group_bootstrap(t.orders, "o_custkey", {"s": F.col("o_totalprice"), "n": F.lit(1)}, F.col("s") / F.col("n"), 200)
    return stats.interval(reps)


@query()
def g11_paired_contrast(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_orderkey", F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return stats.paired_contrast(df, "l_orderkey", "a", "b", 50)


@query()
def g12_sign_flip(t: Tables) -> DataFrame:
    df = t.orders.select("o_custkey", (F.col("o_totalprice") - 250_000).alias("d"))
    return stats.sign_flip(df, "o_custkey", "d", 199)


@query("""WITH w AS (SELECT l_suppkey, l_quantity AS q, l_discount AS d, l_extendedprice AS e, 1.0 / count(*) OVER (PARTITION BY l_suppkey) AS w FROM lineitem),
    l AS (SELECT 'l_quantity' AS a, 'l_discount' AS b, w, q AS x, d AS y FROM w UNION ALL SELECT 'l_quantity', 'l_extendedprice', w, q, e FROM w UNION ALL SELECT 'l_discount', 'l_extendedprice', w, d, e FROM w)
    SELECT a, b, round((sum(w * x * y) / sum(w) - sum(w * x) * sum(w * y) / sum(w) / sum(w)) / sqrt((sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2) * (sum(w * y * y) / sum(w) - (sum(w * y) / sum(w)) ** 2)), 6) AS r FROM l GROUP BY 1, 2""")
def g15_group_balanced_correlation(t: Tables) -> DataFrame:
    c = ["l_quantity", "l_discount", "l_extendedprice"]
    return stats.weighted_correlations(stats.group_balanced(t.lineitem, "l_suppkey", c), c).withColumn("r", F.round("r", 6))


@query()
def g14_vif(t: Tables) -> DataFrame:
    c = ["l_quantity", "l_discount", "l_extendedprice"]
    return stats.vif(stats.group_balanced(t.lineitem, "l_suppkey", c), c)

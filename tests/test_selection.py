"""Exact quantiles, containment joins and step-up minima against plain versions."""

import itertools
import random

import numpy as np
import pytest


@pytest.mark.parametrize("kind", ["spread", "ties", "edge", "outliers", "equal"])
def test_quantiles_narrow_to_the_exact_values(spark, kind):
    from orefield.operators.quantiles import quantiles

    r = np.random.default_rng(3)
    values = {
        "spread": r.normal(size=4_000), "ties": r.integers(0, 7, 4_000).astype(float), "edge": np.concatenate([np.full(2_000, 5.0), r.normal(5, 9, 2_000)]),
        "outliers": np.concatenate([r.normal(size=4_000), [1e300, -1e300]]), "equal": np.full(4_000, 2.5),
    }[kind]
    rows = [("a" if i % 3 else None, float(v)) for i, v in enumerate(values)] + [("few", 1.0), ("few", 4.0), ("few", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    at = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    got = {x.g: x.quantiles for x in quantiles(df, "v", at, ["g"], held=200).collect()}
    assert set(got) == {"a", None, "few"}
    for g in got:
        np.testing.assert_allclose(got[g], np.quantile([v for k, v in rows if k == g and v is not None], at), rtol=1e-12)
    whole = quantiles(df, "v", [0.5], held=200).first().quantiles
    np.testing.assert_allclose(whole, np.quantile([v for _, v in rows if v is not None], [0.5]), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    from orefield.operators.quantiles import column_quantiles, quantiles

    df = spark.createDataFrame([(None, 1)], "v double, w int")
    assert quantiles(df.limit(0), "v", [0.5]).count() == 0 and quantiles(df, "v", [0.5], ["w"]).count() == 0
    assert tuple(column_quantiles(df, ["v", "w"], [0.5]).first()) == (None, [1.0])


@pytest.mark.parametrize(("wide", "hot"), [(32, 1 << 20), (3, 1 << 20), (3, 20), (0, 1), (32, 7)])
def test_containing_against_all_pairs(spark, monkeypatch, wide, hot):
    from orefield.operators import joins

    monkeypatch.setattr(joins, "WIDE", wide)
    monkeypatch.setattr(joins, "HOT", hot)
    r = random.Random(8)
    items = [f"i{k}" for k in range(12)]
    baskets = {b: {i for k, i in enumerate(items) if r.random() < 1 / (k / 3 + 1)} for b in range(90)}
    sets = dict(enumerate([set(c) for n in (1, 2, 3, 4) for c in r.sample(list(itertools.combinations(items, n)), 12)] + [{"nowhere"}, {"i0", "nowhere"}, set(items)]))
    rows = [(b, i) for b, held in baskets.items() for i in held] * 2 + [(1000, None)]
    left = spark.createDataFrame([(s, sorted(x) + sorted(x)[:1]) for s, x in sets.items()] + [(9000, [])], "set_id int, items array<string>")
    got = sorted((x.set_id, x.basket_id) for x in joins.containing(left, spark.createDataFrame(rows, "basket_id int, item string")).collect())
    assert got == sorted((s, b) for s, x in sets.items() for b, held in baskets.items() if x <= held)


def test_step_up_with_ties_and_nulls(spark):
    from orefield.operators.stats import benjamini_hochberg

    p = [0.001, 0.01, 0.02, 0.04, 0.2, 0.9, 0.02, 0.02, 1.0, 0.04]
    got = {x.i: x.q for x in benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").collect()}
    order = np.argsort(p)
    q = np.minimum.accumulate((np.array(p)[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1].clip(max=1)
    for place, i in enumerate(order):
        last = max(j for j in range(len(p)) if p[order[j]] == p[i])
        assert got[i] == pytest.approx(q[last]) == pytest.approx(q[place])
    nulls = benjamini_hochberg(spark.createDataFrame([(0, None), (1, 0.01)], "i int, p double"), "p").collect()
    assert {x.i: x.q for x in nulls} == {0: None, 1: 0.02}


def test_holdout_report_by_hand(spark):
    from orefield.functions.measures import measured
    from orefield.operators import patterns as P

    train = [(b, i) for b, held in enumerate(["ab"] * 6 + ["a"] * 2 + ["c"] * 4 + ["bc"] * 2) for i in held]
    other = [(b, i) for b, held in enumerate(["ab"] * 8 + ["b"] * 2 + ["d"] * 10) for i in held]
    b, o = (spark.createDataFrame(x, "basket_id int, item string") for x in (train, other))
    rules = measured(P.rules(P.eclat(b, 0.2, 2), 14, 1), ["confidence", "lift"])
    judged = P.replicated(P.holdout(rules, o), 0.5, 1.0)
    by = {(x.antecedent[0], x.consequent[0]): x for x in judged.collect()}
    assert {k: (x.h11, x.h1, x.hm1, x.hn, x.replicated, x.validated) for k, x in by.items()} == {("a", "b"): (8, 8, 10, 20, True, True), ("b", "a"): (8, 10, 8, 20, True, True)}
    report = P.holdout_report(judged, o).first()
    assert (report.n_rules, report.n_baskets, report.n_replicated, report.n_validated, report.coverage) == (2, 20, 2, 2, 0.5)
    assert report.firing_precision == pytest.approx(16 / 18) and report.confidence_drift_mean == pytest.approx((1 - 6 / 8 + 0.8 - 6 / 8) / 2)


def test_running_sums_over_strings(spark):
    from pyspark.sql import functions as F

    from orefield.operators.ordering import running_by_range

    r = random.Random(2)
    rows = [(f"w{i}", r.randint(1, 5)) for i in range(500)] + [(None, 3)]
    df = spark.createDataFrame(rows, "token string, n long").repartition(5)
    got = {x.token: (x.rank, x.upto) for x in running_by_range(df, [F.desc("n"), F.asc_nulls_first("token")], {"rank": F.lit(1), "upto": F.col("n")}).collect()}
    total = 0
    for place, (token, n) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0] or "")), 1):
        total += n
        assert got[token] == (place, total)
    assert running_by_range(df.limit(0), [F.asc("token")], {"rank": F.lit(1)}).count() == 0


@pytest.mark.parametrize("slots", [1024, 3])
def test_kendall_against_all_pairs(spark, slots):
    from orefield.operators.aggregates import kendall

    r = random.Random(6)
    rows = [(v := r.choice([r.random(), float(r.randint(0, 3))]), f"{int(v * 20 + r.randint(0, 9)):03d}") for _ in range(150)]
    sign = lambda a, b: (a > b) - (a < b)
    s = sum(sign(a[0], b[0]) * sign(a[1], b[1]) for a, b in itertools.combinations(rows, 2))
    tied = [sum(a[i] != b[i] for a, b in itertools.combinations(rows, 2)) for i in (0, 1)]
    df = spark.createDataFrame([*rows, (None, "1"), (1.0, None)], "x double, y string")
    assert kendall(df, "x", "y", slots).first().tau == pytest.approx(s / (tied[0] * tied[1]) ** 0.5)
    assert kendall(df.limit(0), "x", "y").first().tau == 0 and kendall(df.filter("x = 1"), "x", "y").first().tau == 0


def test_kendall_over_ranges_makes_no_row_a_level(spark, monkeypatch):
    from orefield.operators import aggregates

    monkeypatch.setattr(aggregates, "POINTS", 20)
    r = random.Random(8)
    draw = lambda: r.choice([r.random(), float(r.randint(0, 3)), 7.0])
    rows = [(draw(), draw()) for _ in range(150)]
    sign = lambda a, b: (a > b) - (a < b)
    s = sum(sign(a[0], b[0]) * sign(a[1], b[1]) for a, b in itertools.combinations(rows, 2))
    tied = [sum(a[i] != b[i] for a, b in itertools.combinations(rows, 2)) for i in (0, 1)]
    out = aggregates.kendall(spark.createDataFrame(rows, "x double, y double"), "x", "y")
    assert "Generate explode" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.first().tau == pytest.approx(s / (tied[0] * tied[1]) ** 0.5, abs=1e-12)
    nan = float("nan")
    assert aggregates.kendall(spark.createDataFrame([(nan, 1.0), (nan, 2.0), (1.0, 0.0)], "x double, y double"), "x", "y").first().tau == pytest.approx(2 / (2 * 3) ** 0.5)


def test_equal_baskets_are_mined_and_served_once(spark):
    from orefield.operators import patterns as P
    from orefield.functions.measures import measured

    r = random.Random(9)
    kinds = [tuple(sorted(r.sample("abcdef", r.randint(1, 4)))) for _ in range(6)]
    baskets = {i: r.choice(kinds) for i in range(80)}
    b = spark.createDataFrame([(i, x) for i, s in baskets.items() for x in s] + [(None, "a"), (None, "b")], "basket_id long, item string")
    assert P.contents(b).filter("NOT loose").count() == len(set(baskets.values()))
    mined = P.Itemsets(b, 0.1, 3)
    want = {}
    for s in baskets.values():
        for k in (1, 2, 3):
            for c in itertools.combinations(s, k):
                want[c] = want.get(c, 0) + 1
    for x in "ab":
        want[(x,)] = want.get((x,), 0) + 1
    assert mined.n == 81
    assert {tuple(x["items"]): x["count"] for x in mined.kept.collect()} == {c: n for c, n in want.items() if n >= 9}
    rules = measured(P.rules(mined.kept, mined.n, 1), ["confidence"])
    best = {}
    for x in rules.collect():
        best.setdefault(x.antecedent[0], []).append((x.confidence, x.consequent[0]))
    own = b.filter("basket_id IS NOT NULL")
    got = {}
    for x in P.recommend(rules.filter("size(consequent) = 1"), own, 2).collect():
        got.setdefault(x.basket_id, {})[x.place] = (x.item, x.confidence)
    for i, s in baskets.items():
        offers = {}
        for a in s:
            for c, item in best.get(a, []):
                if item not in s:
                    offers[item] = max(offers.get(item, 0), c)
        assert got.get(i, {}) == {p: x for p, x in enumerate(sorted(offers.items(), key=lambda x: (-x[1], x[0]))[:2], 1)}


def test_pairs_by_shared_tids_are_dealt_by_their_number(spark, monkeypatch):
    from orefield.operators import patterns as P

    monkeypatch.setattr(P, "DEALT", 5)
    r = random.Random(10)
    rows = [(r.randrange(9), r.randrange(12)) for _ in range(70)] + [(None, 1), (1, None), (2, None)]
    out = P.tid_intersections(spark.createDataFrame(rows, "s long, o long"), "s", "o")
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    of = {}
    for s, o in rows:
        if s is not None and o is not None:
            of.setdefault(s, set()).add(o)
    assert {(x.a, x.b): x.both for x in out.collect()} == {(a, b): len(of[a] & of[b]) for a, b in itertools.combinations(sorted(of), 2) if of[a] & of[b]}


def test_r_squared_is_one_aggregate(spark):
    from orefield.operators.evaluation import r_squared, regression_scores

    df = spark.createDataFrame([(float(i), i + (i % 3) * 0.5) for i in range(20)], "y double, p double")
    assert r_squared(df).first().r2 == pytest.approx(regression_scores(df).first().r2)


def test_scenarios_are_compared_within_the_row(spark):
    from orefield import catalogue

    assert "explode" not in catalogue.queries()["x33_scenarios"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().lower()

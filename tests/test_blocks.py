"""Operators that compare every row with every one asked for, in small blocks, against plain loops."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orefield.operators import blocks, clusters, retrieval


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 7)
    monkeypatch.setattr(blocks, "ASKED", 3)


def test_silhouettes_make_no_pairs_and_are_those_of_all_pairs(spark, small, monkeypatch):
    draw = random.Random(3)
    rows = [(i, draw.choice("abc"), draw.choice([0.0, 1.5, 4.0]), float(draw.randrange(4))) for i in range(60)]
    rows += [(60, "a", None, 1.0), (61, None, 1.0, 1.0), (62, "d", 2.0, 2.0), (None, "b", 9.0, 9.0), (5, "b", 7.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, l string, x double, y double")
    planned = []
    kept = clusters.written
    monkeypatch.setattr(clusters, "written", lambda d, what: planned.append(d) or kept(d, what))
    out = clusters.silhouette_profile(df, df.filter("k % 4 <> 3"), "k", "l", ["x", "y"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "o.k" not in plan and "CartesianProduct" not in plan and "FlatMapCoGroupsInArrow" in plan
    d = {}
    for s in rows:
        if s[0] is not None and s[0] % 4 != 3:
            for o in rows:
                if o[0] is not None and o[0] != s[0]:
                    far = None if None in (s[2], s[3], o[2], o[3]) else math.hypot(o[2] - s[2], o[3] - s[3])
                    d.setdefault((s[0], s[1]), {}).setdefault(o[1], []).append(far)
    want = {}
    for (_, own), by in d.items():
        mean = {k: sum(x for x in v if x is not None) / sum(x is not None for x in v) for k, v in by.items() if k is not None and any(x is not None for x in v)}
        a, others = mean.get(own), [v for k, v in mean.items() if k != own and own is not None]
        want.setdefault(own, []).append(0.0 if a is None else (min(others) - a) / max(a, min(others)))
    got = {r.label: (r.n, round(r.silhouette, 9), round(r.negative, 9)) for r in out.collect()}
    assert got == {k: (len(v), round(sum(v) / len(v), 9), round(sum(x < 0 for x in v) / len(v), 9)) for k, v in want.items()}


@pytest.mark.parametrize("k", [1, 3, 50])
def test_nearest_of_all_rows(spark, small, k):
    draw = random.Random(5)
    rows = [(i, [float(draw.randrange(-2, 3)) for _ in range(3)]) for i in range(25)]
    rows = [(i, v if any(v) else [1.0, 0.0, 0.0]) for i, v in rows] + [(25, None), (26, [1.0, None, 2.0]), (27, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "doc_id long, v array<float>")
    asked = df.filter("doc_id % 5 = 0 or doc_id > 25").withColumnRenamed("doc_id", "query_id")

    def cosine(a, b):
        if a is None or b is None or None in a or None in b or len(a) != len(b):
            return None
        return round(sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b)), 9)

    want = set()
    for q, w in rows:
        if q % 5 == 0 or q > 25:
            all_ = sorted(((cosine(v, w), d) for d, v in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
            want |= {(q, d, s, i) for i, (s, d) in enumerate(all_[:k], 1)}
    out = retrieval.dense(df, asked, k)
    assert "CoGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.query_id, r.doc_id, r.score, r["rank"]) for r in out.collect()} == want


def test_nearest_by_distance_leaves_the_row_itself_out(spark, small):
    draw = random.Random(6)
    rows = [(i, [1e4 + draw.randrange(3) * 1e-6, float(draw.randrange(3))]) for i in range(30)] + [(30, None)]
    df = spark.createDataFrame(rows, "doc_id long, v array<double>")
    found = blocks.nearest(df, df.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("w")), 2, "distance", other_only=True)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((math.inf if r.score is None else r.score, r.doc_id))
    for q, w in rows[:30:4]:
        want = sorted((math.inf if v is None else round(math.sqrt(sum((x - y) ** 2 for x, y in zip(v, w))), 8), d) for d, v in rows if d != q)
        assert sorted(got[q])[:2] == want[:2]


def test_bm25_and_overlap_make_no_row_for_a_shared_term(spark, small):
    draw = random.Random(7)
    text = lambda n: " ".join(draw.choice(["the", "the", "a", "b", "cat", "dog", "x1"]) for _ in range(n))
    docs = [(i, text(draw.randrange(1, 9))) for i in range(40)] + [(40, None), (41, "¿?")]
    queries = [(i, text(3)) for i in range(5)] + [(5, "zebra"), (6, "")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    took = lambda x: Counter(re.findall(retrieval.TOKEN, (x or "").lower()))
    tf = {i: took(x) for i, x in docs if took(x)}
    n, mean = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log((n - x + 0.5) / (x + 0.5)) for w, x in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: low if x < 0 else x for w, x in idf.items()}
    want, shared = set(), set()
    for i, x in queries:
        scores = {j: round(sum(m * idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, m in took(x).items() if w in c), 9) for j, c in tf.items() if set(c) & set(took(x))}
        want |= {(i, j, scores[j], r) for r, j in enumerate(sorted(scores, key=lambda j: (-scores[j], j))[:4], 1)}
        both = {j: len(set(c) & set(took(x))) for j, c in tf.items() if set(c) & set(took(x))}
        shared |= {(i, j, both[j], r) for r, j in enumerate(sorted(both, key=lambda j: (-both[j], j))[:4], 1)}
    out = retrieval.bm25(d, q, 4)
    assert "CoGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.query_id, r.doc_id, r.score, r["rank"]) for r in out.collect()} == want
    assert {(r.query_id, r.doc_id, r.score, r["rank"]) for r in retrieval.overlap(d, q, 4).collect()} == shared

"""Sketches of texts against the same built of Spark's own functions."""

from pyspark.sql import functions as F

from orefield.functions.scalars import hash_form, shingles
from orefield.operators import text as K

TEXTS = ["", "one", "a b c d e", "A  b, c d e!", "the cat sat on the mat and the cat sat on the mat", "Größe ÄÖ 中文 字 x y z", " ".join(f"w{i % 700}" for i in range(900)), None, "¿?"]


def test_one_pass_gives_the_values_of_xxhash64(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    s = F.transform(shingles(hash_form(F.col("text")), 5), lambda x: F.xxhash64(x))
    sig = df.select("id", s.alias("s")).select("id", F.array_sort("s").alias("s"), K.minhash(F.col("s"), 64).alias("sig"))
    keys = F.array(*[F.xxhash64(F.lit(b), F.slice("sig", b * 4 + 1, 4)) for b in range(16)])
    want = {r.id: (r.s, r["keys"]) for r in sig.withColumn("keys", keys).collect()}
    want[7] = None, None  # a null text has no shingles, as in SQL, where these made up one
    made = K.sketched(df, 5, 16, 4)
    got = made.collect()
    assert {r.id: (r.s, r["keys"]) for r in got} == want
    assert {r.id: r.h for r in got if r.id != 7} == {r.id: r.h for r in sig.filter("id <> 7").select("id", F.xxhash64("s").alias("h")).collect()}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # later steps read the table, and no text again
    by = {r.id: r.form for r in got}
    assert by[2] == by[3] and by[0] == by[8] and by[7] is None and len(set(by.values())) == 7


def test_texts_are_sketched_once(spark, monkeypatch):
    """Clusters, planted copies and the audit hashed all texts three or four times each."""
    calls = []
    kept = K.sketches
    monkeypatch.setattr(K, "sketches", lambda *a: calls.append(a) or kept(*a))
    df = spark.createDataFrame([(i, " ".join(f"w{(i // 2) * 50 + j}" for j in range(30))) for i in range(8)], "id long, text string")
    assert {r.id: r.cluster for r in K.near_clusters(df).collect()} == {i: i - i % 2 for i in range(8)}
    assert calls == [(5, 16, 4)]
    monkeypatch.setattr(K, "LOOKED_UP", 0)
    assert {r.id: r.cluster for r in K.near_clusters(df).collect()} == {i: i - i % 2 for i in range(8)}


def test_bigrams_are_counted_once_and_match_plain_counts(spark):
    import math
    from collections import Counter

    train = ["a b a b c", "A  b", "lone", None, "", " c a "]
    test = ["a b z", "b c", "only", None, "lone a"]
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    split = lambda texts: [(t or "").lower().split() for t in texts]
    n = Counter(p for w in split(train) for p in zip(w, w[1:]))
    of = Counter(x for w in split(train) for x in w[:-1])
    types = len({x for w in split(train) for x in w}) + 1
    asked = [p for w in split(test) for p in zip(w, w[1:])]
    out = K.bigram_entropy(frame(train), frame(test))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # no text is split again; all comes from the table
    got = out.first()
    assert got.bigrams == len(asked)
    assert abs(got.nats + sum(math.log((n[p] + 1) / (of[p[0]] + types)) for p in asked) / len(asked)) < 1e-12


def test_holders_build_no_strings_of_three_words(spark):
    from orefield.operators import retrieval as R

    docs = spark.createDataFrame([(1, "x one two  three four five y"), (2, "one two three four five"), (3, None), (4, "four two"), (5, "a one two three four fiver")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three four five"), (8, "four two"), (9, "")], "query_id long, item string")
    out = R.holders(docs, items)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.query_id, r.doc_id) for r in out.collect()} == {(7, 2), (7, 5), (8, 4), (9, 1), (9, 2), (9, 4), (9, 5)}

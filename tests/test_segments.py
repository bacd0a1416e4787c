"""Global orders, segment searches and reading grades against plain Python."""

import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from orefield.functions import scalars as X
from orefield.operators import business as B
from orefield.operators import segments as S
from orefield.operators.ordering import placed, running, tiled

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("order", [["x", "k"], ["-x", "k"], ["-x", "-k"]])
def test_running_sums_over_ties_nulls_and_a_hot_value(spark, order):
    rnd = random.Random(3)
    rows = [(i, 5 if rnd.random() < 0.4 else rnd.choice([None, 1, 2, 9, rnd.randrange(1000)]), rnd.randrange(10)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k LONG, x LONG, v LONG").repartition(7)
    got = {r.k: (r.total, r.place) for r in running(df, order, {"total": F.col("v"), "place": F.lit(1)}, parts=8).collect()}
    sign_x, sign_k = (-1 if o.startswith("-") else 1 for o in order)
    total = 0
    for place, (k, x, v) in enumerate(sorted(rows, key=lambda r: (sign_x * (-math.inf if r[1] is None else r[1]), sign_k * r[0])), 1):
        total += v
        assert got[k] == (total, place)


def test_orders_of_empty_and_constant_tables(spark):
    assert placed(spark.createDataFrame([], "k LONG"), ["k"]).count() == 0
    only_null = spark.createDataFrame([(None,)], "k LONG")
    assert [r.place for r in placed(only_null, ["k"]).collect()] == [1]
    assert sorted(r.place for r in placed(spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "a LONG, k LONG"), ["a", "k"]).collect()) == [1, 2, 3]


@pytest.mark.parametrize("n", [3, 10, 23, 40])
def test_tiles_are_ntile(spark, n):
    df = spark.range(n).withColumn("x", F.pmod(F.col("id") * 7, F.lit(5)))
    df.createOrReplaceTempView("rows_to_tile")
    want = {r.id: r.t for r in spark.sql("SELECT id, ntile(10) OVER (ORDER BY x, id) AS t FROM rows_to_tile").collect()}
    assert {r.id: r.tile for r in tiled(df, ["x", "id"], 10).collect()} == want


def test_objective_puts_what_is_feasible_first(spark):
    rows = [(0, 4, 0.2, 0.4, 0.9, 0.5, 1.0, 100.0), (1, 2, 0.01, 0.99, 0.08, 1.0, 0.0, 900.0), (2, 1, 1.0, 1.0, 0.0, None, None, None)]
    table = spark.createDataFrame(rows, "number INT, found LONG, least DOUBLE, most DOUBLE, entropy DOUBLE, silhouette DOUBLE, davies_bouldin DOUBLE, calinski_harabasz DOUBLE")
    out = {r.number: r for r in S.anytime(S.objective(table, 100.0)).collect()}
    assert out[0].objective == pytest.approx(0.5 * 0.75 + 0.3 * 0.5 + 0.2 * 0.5) and out[0].feasible
    penalty = 0.35 * (0.03 - 0.01) / 0.03 + 0.30 * (0.99 - 0.60) / 0.40 + 0.08
    assert out[1].penalty == pytest.approx(penalty) and out[1].objective == pytest.approx(0.5 + 0.3 + 0.2 * 0.9 - penalty - 1)
    assert out[2].objective == -1 and not out[2].feasible
    assert [out[i].place for i in (0, 1, 2)] == [1, 2, 3] and out[2].best_so_far == out[0].objective


def test_personas_are_greedy_and_unique(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.uniform(-2, 2), rnd.uniform(-2, 2)) for i in range(6)]
    kinds = {"a": lambda x, y: x, "b": lambda x, y: y, "c": lambda x, y: -x - y}
    table = spark.createDataFrame(rows, "segment INT, x DOUBLE, y DOUBLE")
    got = {r.segment: r.persona for r in S.personas(table, "segment", ["x", "y"], {k: f(F.col("x"), F.col("y")) for k, f in kinds.items()}).collect()}
    want = {}
    for _, i, name in sorted((-f(x, y), i, name) for i, x, y in rows for name, f in kinds.items()):
        if i not in want and name not in want.values():
            want[i] = name
    for i, x, y in rows:
        want.setdefault(i, ("high " if (x if abs(x) > abs(y) else y) > 0 else "low ") + ("x" if abs(x) > abs(y) else "y"))
    assert got == want and len(set(list(got.values()))) >= 3


def test_the_smallest_model_within_one_error_is_chosen(spark):
    rows = [("big", 3, s) for s in (0.90, 0.80, 0.85)] + [("mid", 2, s) for s in (0.84, 0.83, 0.82)] + [("small", 1, s) for s in (0.1, 0.2, 0.1)]
    out = {r.config: r for r in S.chosen_within_one_error(spark.createDataFrame(rows, "config STRING, size INT, score DOUBLE"), "config", "size").collect()}
    assert out["big"].best and out["mid"].chosen and not out["small"].chosen


def test_last_change_decides(spark):
    rows = [(1, 1, "del"), (1, 2, "back"), (2, 1, "done"), (2, 2, "del"), (3, 1, "done"), (4, 1, "other"), (5, 1, "done"), (5, 2, "open")]
    out = {r.k: (r.deleted, r.done, r.cleared) for r in B.clear_completed(B.soft_state(spark.createDataFrame(rows, "k INT, at INT, kind STRING"), "k", ["at"], "kind", ["del"], ["back"], ["done"], ["open"])).collect()}
    assert out == {1: (False, False, False), 2: (True, True, False), 3: (True, True, True), 4: (False, False, False), 5: (False, False, False)}


def graded(text):
    sentences = [s for s in re.split(r"[.!?]+", text) if s.strip(" \t\n\x0b\x0c\r")]
    words = re.findall(r"\b[a-zA-Z'-]+\b", text)
    if not sentences or not words:
        return None
    said = sum(max(1, len(re.findall("[aeiouy]+", w.lower())) - (w.lower().endswith("e") and not w.lower().endswith("le"))) for w in words)
    return len(sentences), len(words), said, round(max(1, 0.39 * len(words) / len(sentences) + 11.8 * said / len(words) - 15.59), 6)


def test_reading_grade(spark):
    texts = ["", "...", "A table. The fire! Don't go?", "l'été café naïve", None, "one--two -three- 'four'"]
    if os.path.isdir(SF_DIR):
        texts += [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, text STRING")
    for r in df.select("i", X.reading_grade(F.col("text")).alias("g")).collect():
        want = None if texts[r.i] is None else graded(texts[r.i])
        assert (None if r.g is None else (r.g.sentences, r.g.words, r.g.syllables, round(r.g.grade, 6))) == want


def test_chunks_carry_their_section(spark):
    text = "intro " * 25 + "\n## First part \n" + "w " * 300 + "\n# Short\nfew words"
    out = spark.createDataFrame([(7, text)], "k INT, text STRING").select(F.inline(X.cited_chunks(F.col("k"), F.col("text")))).collect()
    assert [r.id for r in out] == ["7#(preamble)#0", "7#First part#0", "7#First part#1", "7#First part#2"]
    assert out[1].text.startswith("First part. w w") and len(out[3].text.split()) == 2 + 300 - 272

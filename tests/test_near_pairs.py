"""All pairs at the threshold, held against every two sets of shingles compared."""

import random
import re

from orefield import catalogue
from orefield.operators import text as K


def grams(text, k=5):
    w = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", text.lower())).strip().split(" ")
    return frozenset(" ".join(w[i : i + k]) for i in range(max(len(w) - k + 1, 1)))


def jaccard(x, y):
    return len(x & y) / len(x | y)


def frame(spark, docs):
    return spark.createDataFrame(docs, "id long, text string")


def corpus(seed, groups=5, each=9):
    """Texts that share passages of their group and one of all, with words changed; some are equal, some too short for a shingle."""
    rng = random.Random(seed)
    docs = []
    for g in range(groups):
        base = [f"p{j}" for j in range(rng.randrange(30))] + [f"g{g}x{j}" for j in range(rng.randrange(20, 80))]
        for c in range(each):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"c{c}"
            docs.append((len(docs), " ".join(w[: len(w) - rng.randrange(8)])))
    return docs + [(len(docs) + i, t) for i, t in enumerate(["a b", "A, b!", "c", "", "...", None])]


def test_a_pair_that_agrees_on_no_band(spark, tmp_path):
    """Jaccard 0.811, 64 min-hashes in 16 bands of which none is the same: left out while pairs came from bands."""
    w = [f"w5242x{j}" for j in range(100)]
    v = [*w]
    v[20] = v[70] = "z"
    df = frame(spark, [(1, " ".join(w)), (2, " ".join(v)), (3, " ".join(f"o{j}" for j in range(100)))])
    first, second = (set(enumerate(r["keys"])) for r in K.sketched(df.filter("id < 3"), 5, 16, 4).orderBy("id").collect())
    assert not first & second
    want = round(jaccard(grams(" ".join(w)), grams(" ".join(v))), 8)
    assert {(r.a, r.b, round(r.similarity, 8)) for r in K.near_pairs(df, df).collect()} == {(1, 2, want), (2, 1, want)}
    assert [(r.a, r.b, round(r.similarity, 8)) for r in K.near_pairs(df.filter("id = 1"), df.filter("id <> 1")).collect()] == [(1, 2, want)]
    df.withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in catalogue.queries()["k3_near_pairs"](spark, str(tmp_path)).collect()] == [(1, 2, want)]


def test_every_pair_at_any_threshold(spark):
    docs = corpus(1)
    df = frame(spark, docs)
    sets = {i: grams(t) for i, t in docs if t is not None}
    least = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    for similarity, block in ((0.2, 512), (0.8, 4)):
        want = {(i, j): jaccard(x, y) for x, i in least.items() for y, j in least.items() if i != j and jaccard(x, y) >= similarity}
        got = K.near_pairs(df, df, similarity=similarity, block=block).collect()
        assert {(r.a, r.b): r.similarity for r in got} == want and len(got) == len(want)
    left, right = {i: s for i, s in sets.items() if i % 2}, {i: s for i, s in sets.items() if i % 2 == 0}
    mine, other = ({s: min(i for i in side if side[i] == s) for s in side.values()} for side in (left, right))
    want = {(i, j): jaccard(x, y) for x, i in mine.items() for y, j in other.items() if jaccard(x, y) >= 0.5}
    got = K.near_pairs(df.filter("id % 2 = 1"), df.filter("id % 2 = 0"), similarity=0.5).collect()
    assert {(r.a, r.b): r.similarity for r in got} == want and len(got) == len(want)


def test_copies_are_pairs_too(spark, tmp_path):
    """k3_near_pairs gave pairs of the first of equal texts only."""
    docs = corpus(2)
    sets = {i: grams(t) for i, t in docs if t is not None}
    df = frame(spark, docs)
    want = {(i, j): jaccard(sets[i], sets[j]) for i in sets for j in sets if i < j and jaccard(sets[i], sets[j]) >= 0.8}
    got = K.near_documents(df, members=2).collect()
    assert {(r.a, r.b): r.similarity for r in got} == want and len(got) == len(want)
    assert 1.0 in want.values() and min(want.values()) < 1
    df.withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["k3_near_pairs"](spark, str(tmp_path)).collect()
    assert {(r.a, r.b): r.similarity for r in got} == {p: round(s, 8) for p, s in want.items()} and len(got) == len(want)


def test_keys_that_repeat_or_are_null(spark):
    w = [f"w{j}" for j in range(60)]
    x, y, z = " ".join(w), " ".join(w[1:]), " ".join(w[:-1])
    # 5 has two texts that are alike and one of them twice; a pair of ids comes once for each two classes, never of an id with itself
    df = frame(spark, [(5, x), (5, x), (5, y), (7, z), (None, x), (None, z), (9, x), (None, "of nobody else"), (None, "of nobody else")])
    got = sorted((r.a, r.b, round(r.similarity, 6)) for r in K.near_documents(df).collect())
    xy, xz, yz = (round(jaccard(grams(a), grams(b)), 6) for a, b in ((x, y), (x, z), (y, z)))
    assert got == sorted([(5, 7, xz), (5, 7, yz), (5, 9, 1.0), (5, 9, xy), (7, 9, xz)])
    assert sorted((r.a, r.b) for r in K.near_pairs(df, df).filter("a < b").collect()) == [(5, 7), (5, 7)]

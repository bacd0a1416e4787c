"""Collocations against counting every phrase in one dictionary."""

import random
import re
from collections import Counter

import pytest

DOCS = "doc_id long, text string, lang string"


def plain(rows, top=2000):
    total, a = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    a[lang, tuple(words[i : i + n])] += 1
    a = {k: v for k, v in a.items() if v >= 30}
    kept = {}
    for (lang, p), count in a.items():
        longer = [v for (g, q), v in a.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if len(p) > 1 and not any(100 * v >= 80 * count for v in longer):
            cuts = [(2_000_000 * count // (a[lang, p[:k]] + a[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.setdefault(lang, []).append((-score, -count, " ".join(p).encode(), a[lang, p[:k]], a[lang, p[k:]]))
    return {(g, i, p.decode(), -c, left, right, total[g], -s) for g, found in kept.items() for i, (s, c, p, left, right) in enumerate(sorted(found)[:top], 1)}


def corpus(seed=4, n=700):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 5))) for _ in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    fixed = [["New", "York", "City"], ["in", "order", "to"], ["a", "a", "a", "a"], ["once", "upon", "a", "time"]]
    out = []
    for _ in range(n):
        text = []
        for _ in range(r.randint(0, 40)):
            text += r.choice(fixed) if r.random() < 0.08 else r.choices(words, weights)
            text.append(r.choice(["", "", "", "", ",", ".", "\n", "\t", "\r\x0b"]))
        out.append((re.sub(" +", lambda _: r.choice([" ", "  "]), " ".join(text)), r.choice(["en", "en", "en", "de", None])))
    return out + [(None, "en"), ("", "xx"), ("rare words only", "yy")] + [("same text again and again", "zz")] * 40


@pytest.mark.parametrize(("block", "entries", "large", "bits"), [(8 << 20, 1 << 22, 1 << 27, 27), (2000, 1, 1 << 27, 27), (2000, 1, 0, 27), (1000, 3000, 1 << 27, 6)])
def test_same_as_one_dictionary(spark, monkeypatch, block, entries, large, bits):
    from orefield.llm import phrases as ph

    monkeypatch.setattr(ph, "LARGE", large)
    monkeypatch.setattr(ph, "FIELD_BITS", bits)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], DOCS).repartition(5)
    got = {tuple(r) for r in ph.collocations(docs, block=block, entries=entries).collect()}
    assert got == plain(rows) and len(got) > 20


def test_top_ties_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    from orefield.llm.phrases import collocations

    rows = [(f"{w}1 {w}2. ", "en") for w in "çbaéz"] * 30
    docs = spark.createDataFrame([(1, t, g) for t, g in rows], DOCS).withColumns({c: F.lit("x") for c in ("h", "c", "n", "a", "phrase", "words", "size", "k")})
    got = sorted(collocations(docs, top=3).collect(), key=lambda r: r["rank"])
    assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got] == [(f"{w}1 {w}2", 30, 30, 30, 300, 1_000_000) for w in "abz"]


def test_empty_tables_and_few_words(spark):
    from orefield.llm.phrases import collocations

    docs = spark.createDataFrame([(1, "a b", "en"), (None, None, None)], DOCS)
    assert collocations(docs).count() == 0 and collocations(docs.limit(0)).count() == 0

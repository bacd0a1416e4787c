"""Terms of texts, numbered within blocks, against regular expressions and plain loops."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from orefield.operators import blocks, retrieval, tokens

TEXTS = ["the cat", "sat", None, "", "¿?", "größe 5.5% a_b-c", "中文 x中y", "ends with é", "é", " a\tb\n", "cat", "x" * 300]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_terms_are_those_of_the_expression(kind):
    for texts in (TEXTS, TEXTS[::-1], [None], [""], []):
        want = [re.findall(tokens.TOKEN, x or "") for x in texts]
        n, found = tokens.terms(pa.array(texts, kind))
        assert n.tolist() == list(map(len, want)) and found.to_pylist() == sum(want, [])
    n, found = tokens.terms(pa.array(TEXTS, kind).slice(1, 5))
    assert n.tolist() == [1, 0, 0, 0, 4] and found.to_pylist() == ["sat", "gr", "e", "5.5%", "a_b-c"]


@pytest.mark.parametrize(("rows", "size"), [(1, 1 << 20), (3, 1 << 20), (4, 1 << 20), (100, 10), (5, 12), (100, 1)])
def test_blocks_hold_all_rows_in_order(rows, size):
    table = pa.table({"doc_id": list(range(len(TEXTS))), "text": pa.array(TEXTS, pa.string())})
    made = list(tokens.dealt(iter(table.to_batches(max_chunksize=5)), rows, size))
    assert [x for t in made for x in t.column(0).to_pylist()] == list(range(len(TEXTS)))
    for t in made:
        assert 1 <= t.num_rows <= rows
        assert t.num_rows == 1 or sum(len((x or "").encode()) for x in t.column(1).to_pylist()) <= size


@pytest.mark.parametrize(("rows", "size"), [(7, 1 << 20), (1000, 40), (1000, 1 << 20)])
def test_texts_are_read_once_and_no_term_of_a_document_is_a_row(spark, monkeypatch, rows, size):
    """bm25 cut all texts twice, into a row for each term, and brought the terms of a document together again."""
    monkeypatch.setattr(tokens, "ROWS", rows)
    monkeypatch.setattr(tokens, "BYTES", size)
    monkeypatch.setattr(blocks, "ASKED", 3)
    planned, kept = [], retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda d, what: planned.append((what, d._jdf.queryExecution().executedPlan().toString())) or kept(d, what))
    draw = random.Random(8)
    text = lambda n: " ".join(draw.choice(["The", "the", "a", "b", "cat", "dog", "é", f"x{draw.randrange(30)}"]) for _ in range(n))
    docs = [(f"d{i:02}", text(draw.randrange(9))) for i in range(60)] + [("none", None)]
    queries = [(i, text(4)) for i in range(8)] + [(None, "the cat x1"), (9, "zebra")]
    d, q = spark.createDataFrame(docs, "doc_id string, text string").repartition(3), spark.createDataFrame(queries, "query_id int, text string")
    out = retrieval.bm25(d, q, 5)
    assert [what for what, plan in planned if "Generate" in plan] == ["asked"]
    assert [what for what, plan in planned if "lower(text" in plan] == ["postings", "asked"]
    took = lambda x: Counter(re.findall(retrieval.TOKEN, (x or "").lower()))
    tf = {i: took(x) for i, x in docs if took(x)}
    n, mean = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log((n - x + 0.5) / (x + 0.5)) for w, x in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: low if x < 0 else x for w, x in idf.items()}
    want, shared = {}, {}
    for i, x in queries:
        score = {j: sum(m * idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, m in took(x).items() if w in c) for j, c in tf.items() if set(c) & set(took(x))}
        want |= {(i, r): (j, round(score[j], 7)) for r, j in enumerate(sorted(score, key=lambda j: (-round(score[j], 9), j))[:5], 1)}
        both = {j: len(set(c) & set(took(x))) for j, c in tf.items() if set(c) & set(took(x))}
        shared |= {(i, r): (j, both[j]) for r, j in enumerate(sorted(both, key=lambda j: (-both[j], j))[:5], 1)}
    assert {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 7)) for r in out.collect()} == want
    assert {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in retrieval.overlap(d, q, 5).collect()} == shared

"""Winnowing against a plain loop, and neighbours against a sorted list."""

import hashlib
import random
import re
import struct

import pytest
import xxhash

PRIME, BASE, K, W = (1 << 31) - 1, 1_000_003, 5, 8
DOCS = "doc_id long, text string, lang string"


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain(text):
    """The choices of a text, hash by hash and window by window."""
    symbols = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in re.findall(r"[^\x20\x09-\x0D]{1,32}", text or "")]
    if not symbols:
        return []
    padded = symbols + [0] * (K - len(symbols))
    hashes = [sum(s % PRIME * pow(BASE, K - 1 - j, PRIME) for j, s in enumerate(padded[i : i + K])) % PRIME for i in range(len(padded) - K + 1)]
    found = []
    for i in range(max(1, len(hashes) - W + 1)):
        span = range(i, min(i + W, len(hashes)))
        at = max(j for j in span if hashes[j] == min(hashes[x] for x in span))
        if at not in found:
            found.append(at)
    out = []
    for at in found:
        h = 42
        for s in symbols[at : at + K]:
            h = xxhash.xxh64(struct.pack("<q", s), seed=h).intdigest()
        out.append((signed(h), at))
    return out


def like(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def texts():
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdeé😀") for _ in range(r.randint(1, 6))) for _ in range(60)]
    out = [" ".join(r.choice(vocab) for _ in range(n)) for n in [0, 1, 2, 4, 5, 6, 11, 12, 13, 20, 40, 100, 300]]
    return out + [None, "", " \n\t", "same same same " * 40, "x" * 500, out[-1] + " tail", out[-1], " ".join(r.choice(vocab) for _ in range(9000))]


def test_winnowing_as_in_a_loop(spark, monkeypatch):
    from orefield.llm import fingerprints as fp

    data = [(i, t, "en") for i, t in enumerate(texts())]
    want = {i: plain(t) for i, t, _ in data}
    for block in (4096, 16):
        monkeypatch.setattr(fp, "BLOCK", block)
        got = {r.doc_id: [(x.hash, x.position) for x in r.f] for r in spark.createDataFrame(data, DOCS).select("doc_id", fp.winnowed(fp.F.col("text")).alias("f")).collect()}
        assert got == want


def test_a_shared_run_of_words_is_always_found(spark):
    from orefield.llm.fingerprints import F, winnowed

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    pairs = []
    for i in range(40):
        shared = [word() for _ in range(K + W - 1)]
        pairs.append((i, *(" ".join([*(word() for _ in range(r.randint(0, 30))), *shared, *(word() for _ in range(r.randint(0, 30)))]) for _ in range(2))))
    df = spark.createDataFrame(pairs, "i int, a string, b string").select(winnowed(F.col("a")).alias("a"), winnowed(F.col("b")).alias("b"))
    assert df.filter(~F.arrays_overlap(F.transform("a", lambda x: x["hash"]), F.transform("b", lambda x: x["hash"]))).count() == 0


@pytest.mark.parametrize("slot_bytes", [8 << 20, 200])
def test_query_against_a_sorted_list(spark, tmp_path, monkeypatch, slot_bytes):
    from orefield.llm import fingerprints as fp
    from orefield.llm.queries import op11_fingerprints

    monkeypatch.setattr(fp, "SLOT_BYTES", slot_bytes)
    monkeypatch.setattr(fp, "CUTS", 16)
    data = [(7 * i % 101 - 30, t, "en") for i, t in enumerate(texts() * 3)]
    data = list({d: (d, t, x) for d, t, x in data}.values())
    spark.createDataFrame(data, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_fingerprints(spark, str(tmp_path)).collect()}
    rows = sorted((d, t or "") for d, t, _ in data)
    assert len(got) == len(rows)
    show = lambda f: " ".join(f"{h % (1 << 64):016x}:{p}" for h, p in f)
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (show(plain(t)), show(plain(edited)))
        assert (r.near_edited, r.near_next) == (like(plain(t), plain(edited)), like(plain(t), plain(after)))


def test_nulls_repeats_strings_empty_tables_and_clashing_columns(spark, monkeypatch):
    from orefield.llm import fingerprints as fp

    monkeypatch.setattr(fp, "SLOT_BYTES", 20)
    names = ("at", "h", "slot", "border", "to", "level", "upper", "lower", "fingerprint", "edited", "position", "part")
    data = [(None, "a b"), (None, None), ("k", "c d e f g"), ("k", "c d e f g"), ("k", "z"), ("b", "")]
    df = spark.createDataFrame(data, "doc_id string, text string").withColumns({c: fp.F.lit(1) for c in names})
    got = sorted(((r.doc_id, r.text, r.next_text) for r in fp.edited_fingerprints(df).collect()), key=str)
    assert len(got) == len(data) and all(x[2] is not None for x in got)
    assert [x for x in got if x[0] == "b"][0][2] in ("c d e f g", "z")
    assert fp.edited_fingerprints(df.limit(0)).count() == 0
    one = fp.edited_fingerprints(df.filter("text = 'z'")).first()
    assert (one.text, one.next_text, one.edited) == ("z", "z", "z")

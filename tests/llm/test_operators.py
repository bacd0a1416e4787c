"""Each operator against a plain version on small rows: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import pytest
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def rows(texts, source="s"):
    return [(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)]


def table(spark, data, schema=DOCS):
    return spark.createDataFrame(data, schema)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# exact dedup


def test_exact_dedup_keeps_the_smallest(spark):
    from orefield.llm.exact_dedup import exact_dedup

    texts = ["a  b", "a\tb", None, "", "c", " ", "\n\n", "a b ", "x" * 200_000] + ["hot text"] * 50
    docs = table(spark, rows(texts) + [(3, "", "en", "s", 0)])
    got = exact_dedup(docs, summary_size=4).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, *_ in [*rows(texts), (3, "", "en", "s", 0)]:
        groups[norm(t)].append(i)
    assert len(got) == len(texts) + 1
    for norm_text, ids in groups.items():
        sha = hashlib.sha256(norm_text.encode()).hexdigest()
        mine = [r for r in got if r.text_sha256 == sha]
        assert {(r.keep_id, r.group_size) for r in mine} == {(min(ids), len(ids))}
        assert [r.doc_id for r in mine if r.kept] == [min(ids)]


def test_exact_dedup_of_many_groups_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    from orefield.llm.exact_dedup import exact_dedup

    data = [(f"d{i % 90}", f"text {i % 40}", "en", "s", 1) for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id string, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in ("id", "digest", "at", "best", "kept", "group_size")})
    least = {t: min(r[0] for r in data if r[1] == t) for _, t, *_ in data}
    got = exact_dedup(docs, summary_size=3).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter((i, least[t], 10) for i, t, *_ in data)
    assert sum(r.kept for r in got) == 40 and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_null_key_and_empty_table(spark):
    from orefield.llm.exact_dedup import exact_dedup

    docs = table(spark, [(None, "a", "en", "s", 1), (7, "a", "en", "s", 1), (None, "b", None, None, None)])
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect()}
    assert got == {(None, 7, 2, False), (7, 7, 2, True), (None, None, 1, True)}
    assert exact_dedup(docs.limit(0)).count() == 0


def test_misra_gries_keeps_what_is_frequent():
    from orefield.llm.exact_dedup import trim

    counts = trim(Counter({"hot": 50, **{f"r{i}": 1 for i in range(100)}}), 10)
    assert counts == {"hot": 49}


# line dedup


def plain_lines(data):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(lower)
    holders = defaultdict(list)
    for i, text, *_ in data:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(i)
    out = []
    for i, text, *_ in data:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_line_dedup(spark, batches):
    from pyspark.sql import functions as F

    from orefield.llm.line_dedup import line_dedup

    hot, umlaut = "This Line Is Shared By Many Documents, All The Same", "É this line has a capital letter that isn't ASCII É"
    texts = [None, "", "\n\n", hot, f"own {LONG}\n  {hot.upper()}\t\nshort\nshort", f"{hot}\n{hot}", "short\nshort"]
    texts += [f"{hot}\n{umlaut}\nline {i}" for i in range(9)] + [umlaut.lower()] * 3 + ["x" * 100_000]
    data = rows(texts)
    docs = table(spark, data).withColumn("h1", F.lit(1)).withColumn("holder", F.lit("clash"))
    got = line_dedup(docs, n_batches=batches)
    assert {"h1", "holder"} <= set(got.columns)
    out = got.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept_lines")).alias("d"), F.sha2(F.array_join("kept_lines", "\n"), 256).alias("s")).collect()
    assert sorted(tuple(r) for r in out) == plain_lines(data)
    assert line_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["string", "date", "double", "decimal(20,3)", "binary"])
def test_line_dedup_of_keys_of_other_types(spark, kind):
    from pyspark.sql import functions as F

    from orefield.llm.line_dedup import line_dedup

    hot, other = "a line that is long enough to be looked at here", "and one more line that is long enough to be looked at"
    n = 40
    keys = {"string": F.format_string("d%03d", "i"), "date": F.date_add(F.lit("2020-01-01"), F.col("i")), "binary": F.format_string("d%03d", "i").cast("binary")}
    data = [(i, f"{hot}\nown {i}" + (f"\n{other}" if i % 3 == 0 else "")) for i in range(n)] + [(None, f"null {j}\n{hot}") for j in range(30)]
    docs = spark.createDataFrame(data, "i int, text string").withColumn("doc_id", F.when(F.col("i").isNotNull(), keys.get(kind, F.col("i").cast(kind))))
    got = Counter((r.i, *r.kept_lines) for r in line_dedup(docs).collect())
    want = [(i, *([hot] if i == n - 1 else []), f"own {i}", *([other] if i == n - 1 and i % 3 == 0 else [])) for i in range(n)] + [(None, f"null {j}") for j in range(30)]
    assert got == Counter(want)


def test_line_dedup_of_repeated_rows_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    from orefield.llm.line_dedup import line_dedup

    hot = "a line that is long enough to be looked at here"
    data = [(None, f"{hot}\nx", "en", "s", 1)] * 3 + [(4, hot, None, None, None)] * 2 + [(2, f"y\n{hot}", "en", "s", 1)]
    docs = table(spark, data).withColumns({c: F.lit(c) for c in ("n_lines", "_drops", "_drop_id", "drop_id", "drop_text", "of_text", "dropped", "id", "line", "batch")})
    got = line_dedup(docs)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["kept_lines", "n_lines"]
    assert Counter((r.doc_id, *r.kept_lines) for r in got.collect()) == Counter({(None, "x"): 3, (4, hot): 2, (2, "y"): 1})
    nulls = table(spark, [(None, hot, "en", "s", 1)] * 6)
    assert {tuple(r.kept_lines) for r in line_dedup(nulls).collect()} == {(hot,)}


# mixing


def test_water_fill_is_feasible_and_total(spark):
    from orefield.llm.common import Scratch
    from orefield.llm.mixing import water_fill

    sources = spark.createDataFrame([("a", 10, 5.0), ("b", 1000, 2.0), ("c", 500, 1.0), ("d", 0, 5.0)], "src string, source_size long, weight double")
    got = {r.src: r.target for r in water_fill(sources, 1.5 * 1510, 2.0, Scratch(spark, "t")).collect()}
    assert got["a"] == 20 and got["d"] == 0
    assert got["b"] == pytest.approx((2265 - 20) * 2 / 3) and got["c"] == pytest.approx((2265 - 20) / 3)


def test_mix(spark):
    from orefield.llm.mixing import mix

    data = [(i, " ".join(["w"] * (1 + i % 50)), "en", f"s{i % 4}" if i % 5 else None, 1) for i in range(400)]
    data += [(400, None, "en", "s0", 0), (401, "", "en", "empty", 0), (402, " \t\n", None, "s1", 0)]
    docs = table(spark, data)
    got = [r.asDict() for r in mix(docs, buckets=16).collect()]
    assert len(got) == len(data)
    size = Counter()
    for _, t, _, s, _ in data:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, target = 1.5 * sum(size.values()), set(size), {}
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > 2 * size[s]}
        if not above:
            target |= {s: weight[s] * level for s in free}
            break
        for s in above:
            target[s] = 2 * size[s]
            left -= target[s]
        free -= above
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["repeats"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 25.001
    again = mix(docs.repartition(3), buckets=16).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)
    assert mix(docs.limit(0)).count() == 0


def test_mix_of_repeated_rows(spark):
    from pyspark.sql import functions as F

    from orefield.llm.mixing import mix, repeated

    data = [(1, "a b c", "en", "s", 5)] * 2 + [(None, "a b", None, "s", 4)] * 3 + [(2, "w " * 50_000, "en", None, 9), (3, "", "en", "s", 0), (4, None, "en", "s", None)]
    docs = table(spark, data).withColumns({c: F.lit(c) for c in ("id", "size", "target", "s", "h", "repeats", "copy", "src", "position")})
    by_row = [(r.doc_id, r.size, r.source, r.taken) for r in mix(docs).collect()]
    assert Counter(x[:3] for x in by_row) == Counter({(1, 3, "s"): 2, (None, 2, "s"): 3, (2, 50_000, None): 1, (3, 0, "s"): 1, (4, 0, "s"): 1})
    out = repeated(docs)
    assert out.columns == [*docs.columns, "copy_"]
    took = Counter((r.doc_id, len(words(r.text)), r.source) for r in out.collect())
    want = Counter()
    for i, n, s, taken in by_row:
        want[i, n, s] += taken // n if n else took[i, n, s]
    assert took == want and {r.copy for r in out.collect()} == {"copy"}
    assert sum(n * k[1] for k, n in took.items() if k[2] == "s") == 24  # twice its 12 words
    assert repeated(docs.limit(0)).count() == 0


# simhash


def plain_fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(fps, ids, radius=3):
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(set(fps), 2):
        if (a ^ b).bit_count() <= radius:
            up[root(a)] = root(b)
    least = {}
    for f, i in zip(fps, ids):
        least[root(f)] = min(i, least.get(root(f), i))
    return [least[root(f)] for f in fps]


def test_covering_masks_miss_no_pair():
    from orefield.llm.simhash import covering_masks

    masks = covering_masks(3)
    assert len(masks) == 15
    for n in (1, 2, 3):
        for bits in itertools.combinations(range(64), n):
            diff = sum(1 << b for b in bits)
            assert any(not diff & m for m in masks)


@pytest.mark.parametrize("block", [4, 512])
def test_simhash_components(spark, block):
    from orefield.llm.simhash import simhash_components

    base = (LONG + " ") * 12
    near = [base + f"tail{i} " * (i % 3) for i in range(25)]
    texts = [None, "", " \t", "one", "ONE", "one two", "é ü", base.upper(), *near, *(f"text number {i} {LONG[i:]}" for i in range(20))]
    data = rows(texts)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash_components(table(spark, data), block=block).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    want = plain_components(fps, range(len(texts)))
    assert got == {i: (f, c) for i, (f, c) in enumerate(zip(fps, want))}
    assert simhash_components(table(spark, []), block=block).count() == 0


def test_components_of_a_long_path(spark):
    from orefield.llm.common import Scratch
    from orefield.llm.components import components

    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (101, 102), (100, 102), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100}


def test_near_copies(spark):
    from orefield.llm.simhash import near_copies

    w = [f"word{i}" for i in range(200)]
    other = [f"other{i}" for i in range(200)]
    texts = [" ".join(w), " ".join(w[:100] + ["new"] + w[101:]), " ".join(other), " ".join(other).upper(), " ".join(w[:100] + other[:100]), "", None]
    got = {r.doc_id: r.component_id for r in near_copies(table(spark, rows(texts))).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 5}


def test_near_copies_with_a_passage_more(spark):
    """A passage of new words moves all word fingerprints; five-word shingles at 0.82 link nevertheless, those just under 0.8 don't."""
    from orefield.llm.simhash import near_copies

    def pair(i, more):
        w = [f"w{i}x{j}" for j in range(250)]
        return [" ".join(w), " ".join(w + [f"new{i}x{j}" for j in range(more)])]

    # 246 shingles, all of them in the longer text, which has 246 + more
    texts = [t for i in range(30) for t in pair(i, 54 if i < 20 else 63)]
    got = {r.doc_id: r.component_id for r in near_copies(table(spark, rows(texts))).collect()}
    assert got == {i: i - i % 2 if i < 40 else i for i in range(60)}


@pytest.mark.parametrize("block", [4, 2048])
def test_near_copies_are_what_brute_force_finds(spark, block, monkeypatch):
    """A group in which most pairs are a little over or under the similarity, and only some chains of them link."""
    import random

    from orefield.llm import simhash

    rng = random.Random(6)
    base = [[f"b{k}x{j}" for j in range(160)] for k in range(3)]
    texts = []
    for i in range(150):
        w = list(base[i % 3])
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    n_open = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        share = both / len(sets[i] | sets[j])
        n_open += 0.73 < share < 0.87
        if share >= 0.8:
            a, b = sorted((root(i), root(j)))
            up[b] = a
    assert n_open > 300
    monkeypatch.setattr(simhash, "EXACT_BLOCK", block)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(table(spark, rows(texts)), block=max(block, 16)).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


def test_near_copies_of_repeated_rows(spark):
    from pyspark.sql import functions as F

    from orefield.llm.simhash import near_copies, simhash_components, without_near_copies

    w = [[f"w{k}x{j}" for j in range(150)] for k in range(4)]
    base = [" ".join(x) for x in w]
    near = [" ".join(x[:75] + ["new"] + x[76:]) for x in w]
    data = [("b", base[0]), ("a", near[0]), ("a", base[1]), ("a", base[1]), (None, base[2]), (None, near[2]), ("c", base[0]), (None, near[3]), ("d", base[3]), ("e", ""), ("f", None), (None, " ")]
    docs = spark.createDataFrame(data, "doc_id string, text string").withColumns({c: F.lit(c) for c in ("id", "row", "fp", "digest", "component_id", "node")})
    got = Counter((r.doc_id, r.component_id) for r in near_copies(docs).collect())
    assert got == Counter([("b", "a"), ("a", "a"), ("a", "a"), ("a", "a"), (None, None), (None, None), ("c", "a"), (None, "d"), ("d", "d"), ("e", "e"), ("f", "e"), (None, "e")])
    kept = without_near_copies(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()) - Counter([(None, base[2]), (None, near[2])]) == Counter([("a", near[0]), ("a", base[1]), ("d", base[3]), ("e", "")])
    assert kept.count() == 5
    assert near_copies(docs.limit(0)).count() == without_near_copies(docs.limit(0)).count() == 0
    prints = {(r.doc_id, r.component_id) for r in simhash_components(docs.filter("text is null or text = '' or text = ' '")).collect()}
    assert prints == {("e", "e"), ("f", "e"), (None, "e")}


# tokens


def test_token_counts(spark):
    import public_tokenizers
    import sentencepiece

    from orefield.llm.token_count import token_counts

    texts = ["", None, " ", "   ", "a", "  a  b ", "hello\nworld", "\n\n a\n", "a\n\n  b  \n ", "<s>x</s> <unk>", "été ▁x", "x\xa0y", "한漢字🙂", "a\x00b", "ﬁ① ﷽", "aaaa" * 5000, (LONG + " ") * 700]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(table(spark, rows(texts))).collect()}
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 4096), repr(t)[:40]


# toxicity


def toxic_corpus(n, seed=1):
    import random

    rng = random.Random(seed)
    stems = ["lor", "em", "ip", "sum", "dol", "or", "sit", "am", "et", "con"]

    def doc(bad):
        w = ["".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(80)]
        for _ in range(4 * bad):
            w.insert(rng.randrange(80), rng.choice(["jerkface", "numbskull", "blockhead"]))
        return " ".join(w)

    return [(i, doc(i % 3 == 0), int(i % 3 == 0)) for i in range(n)]


def test_toxicity_learns_from_labels(spark):
    from pyspark.sql import functions as F

    from orefield.llm.toxicity import fit, toxicity_scores, without_toxic

    train_rows = toxic_corpus(400) + [(900, None, 1), (901, "", 0), (902, "x", None), (None, "y", 1), (903, "z", 7), (3, "a second text of the same id", 1)]
    labelled = spark.createDataFrame(train_rows, "doc_id long, text string, toxic int")
    docs, labels = labelled.drop("toxic"), labelled.drop("text").unionByName(labelled.drop("text").limit(50))
    model = fit(docs.withColumn("label", F.lit("clash")).withColumn("id", F.lit(1)), labels.withColumn("label", F.lit("clash")))
    test = [(i, t, "en", "s", y) for i, t, y in toxic_corpus(200, 2)] + [(300, None, None, None, None), (301, "", "en", "s", 0), (302, "word " * 50_000, "en", "s", 1), (None, "word", "en", "s", 1), (0, None, "en", "s", 1)]
    got = toxicity_scores(table(spark, test).withColumn("id", F.lit("clash")).withColumn("score", F.lit(2.0)), model).collect()
    assert all(0 <= r.score <= 1 for r in got) and Counter(r.doc_id for r in got) == Counter(r[0] for r in test)
    by_id = {r.doc_id: r.score for r in got if r.doc_id}
    assert sum((by_id[i] >= 0.5) == bool(y) for i, _, _, _, y in test[1:200]) >= 189
    assert by_id[300] == by_id[301] < 0.5
    kept = without_toxic(table(spark, test).withColumn("_id", F.lit("clash")), model)
    assert kept.columns == [*table(spark, test).columns, "_id"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.score < 0.5)
    assert toxicity_scores(table(spark, []), model).count() == 0 and without_toxic(table(spark, []), model).count() == 0


def test_toxicity_fits_within_its_bound(spark):
    from orefield.llm import toxicity

    rows = spark.createDataFrame([(i % 5, t, y) for i, t, y in toxic_corpus(60)], "doc_id long, text string, toxic int")
    seen = []
    real, toxicity.train = toxicity.train, lambda toxic, ordinary, prior: seen.append((toxic, ordinary, prior))
    try:
        toxicity.fit(rows.drop("toxic"), rows.drop("text"), sample=7)
        toxicity.fit(rows.drop("toxic").limit(0), rows.drop("text").limit(0), sample=7)
    finally:
        toxicity.train = real
    assert len(seen[0][0]) == 7 and not seen[0][1] and seen[1] == ([], [], 0.1)  # each key has a toxic label; a key stands for many rows


def test_toxicity_measures_every_window_with_both_dictionaries():
    import random

    import zstandard as zstd

    from orefield.llm.toxicity import TILE, train, windows

    corpus = toxic_corpus(300)
    model = train([t for _, t, y in corpus if y], [t for _, t, y in corpus if not y], 0.3)
    text = "Lorem, JERKFACE! ipsum_1 dolor\nnumbskull " + "x" * 5000
    assert windows(text) == ["lorem", "jerkface", "ipsum_1", "dolor", "numbskull", "x" * 5000]
    assert windows("a b c d e", 2) == ["a b", "c d", "e"]
    for content in (model.ordinary, *model.toxic):
        assert zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_FULLDICT).dict_id()  # trained, not raw
    for w in windows(text):
        b = f" {w} ".encode()
        b *= max(1, -(-TILE // len(b)))
        plain = []
        for content in (model.ordinary, *model.toxic):
            params = zstd.ZstdCompressionParameters(format=zstd.FORMAT_ZSTD1_MAGICLESS, strategy=zstd.STRATEGY_LAZY2, window_log=19, chain_log=17, hash_log=17, search_log=5, min_match=4, target_length=32, write_content_size=0, write_checksum=0, write_dict_id=0)
            plain.append(len(zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content), compression_params=params).compress(b)))
        assert model.lengths(w) == [(min(len(w.encode()), 24), plain[0], x) for x in plain[1:]]
    words = [w for _, t, y in corpus for w in windows(t)]
    gain = lambda w: sum(x[1] - x[2] for x in model.lengths(w))
    assert sum(map(gain, ["jerkface", "numbskull", "blockhead"])) / 3 > sum(map(gain, words)) / len(words)
    odds = [model.window_odds(w) for w in windows(text)]
    again = random.Random(3).sample(words, 500)
    for w in again:  # what is remembered is what is measured
        assert model.window_odds(w) == [odds.get(c, (0.0, 0.0)) for odds, c in zip(model.odds, model.lengths(w))] == model.window_odds(w)
    assert len(odds) == 6


def test_toxicity_odds_without_a_text_are_those_of_the_others():
    from orefield.llm.toxicity import Odds, features

    toxic, ordinary = [[(4, 9, 5), (4, 9, 5), (5, 9, 9)], [(4, 9, 5)], []], [[(5, 9, 9)] * 3, [(6, 8, 9), (5, 9, 9)]]
    for side, texts in enumerate((toxic, ordinary)):
        for i, text in enumerate(texts):
            rest = [[x for j, x in enumerate(y) if (s, j) != (side, i)] for s, y in enumerate((toxic, ordinary))]
            odds = Odds(*rest).of(set(text))
            assert Odds(toxic, ordinary).features_without(text, side) == features([odds[c] for c in text])


def test_toxicity_without_enough_text():
    from orefield.llm.toxicity import train

    assert train([], [], 0.1).score("some text") == 0.1
    assert train(["bad"] * 3, ["good"] * 3, 0.3).score("bad") == 0.3
    assert train([], ["plain words " * 2000] * 4, 0.2).score("") == 0.2


# decontamination


def test_wand_finds_what_brute_force_finds():
    import random

    from orefield.llm.decontamination import Index

    rng = random.Random(2)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(2000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120)))) for i in range(150)]
    index = Index(items, threshold=0.35)
    for _ in range(60):
        text = [rng.choice(vocabulary) for _ in range(60)]
        if rng.random() < 0.5:
            text[10:10] = items[rng.randrange(150)][1].split()[:30]
        terms = {index.vocabulary[t] for t in text if t in index.vocabulary}
        plain = Counter()
        for t in terms:
            for p, u in zip(index.parts[t], index.impacts[t]):
                plain[int(p)] += u
        want = {p: s for p, s in plain.items() if s >= 0.35 - 1e-9}
        got = index.wand(list(terms))
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_contaminated(spark):
    from orefield.llm.decontamination import contaminated

    q = [f"question{i} {LONG} number{i}. The answer is item{i} exactly so." for i in range(30)]
    items = spark.createDataFrame([*enumerate(q), (97, None), (98, ""), (99, " ... ")], "item_id long, text string")
    texts = [f"before {q[3]} after", q[4].upper(), f"{LONG} alone without its question", None, "", "x " * 20_000 + q[5] + " y" * 20_000, f"{q[6]} and {q[7]}", q[8].split(".")[0]]
    got = {(r.doc_id, r.item_id) for r in contaminated(table(spark, rows(texts)), items).collect()}
    assert got == {(0, 3), (1, 4), (5, 5), (6, 6), (6, 7)}
    assert contaminated(table(spark, []), items).count() == 0
    assert contaminated(table(spark, rows(texts)), items.limit(0)).count() == 0


def plain_contaminated(docs, items):
    """Every passage of every document against every part of every item by BM25 (items with the same text are one), then the overlaps."""
    import math

    from orefield.llm.decontamination import B, K1, OVERLAP, PART, THRESHOLD, parts_of, question_and_answer, shingles, tokens

    keys = defaultdict(list)
    for k, x in items:
        keys[x or ""].append(k)
    parts = [(x, Counter(p)) for x in keys for p in parts_of(sum(question_and_answer(x), []))]
    df = Counter(t for _, p in parts for t in p)
    mean = sum(sum(p.values()) for _, p in parts) / len(parts)

    def weights(p):
        size = sum(p.values())
        w = {t: math.log(1 + (len(parts) - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean)) for t, n in p.items()}
        return {t: x / sum(w.values()) for t, x in w.items()}

    impacts = [(k, weights(p)) for k, p in parts]
    out = []
    for i, text in docs:
        words = tokens(text or "")
        best = {}
        for at in range(0, len(words), PART):
            passage = set(words[at : at + 2 * PART])
            for k, w in impacts:
                score = sum(x for t, x in w.items() if t in passage)
                if score >= THRESHOLD - 1e-9:
                    best[k] = max(score, best.get(k, 0))
        for k, score in best.items():
            q, a = question_and_answer(k)
            grams, first = shingles(q + a), max(0, len(q) - 4)
            of_q, of_a, held = set(grams[:first]) or set(grams), set(grams[first:]), set(shingles(words, len(grams[0])))
            share = lambda x: len(x & held) / len(x) if x else 1.0
            if share(of_q) >= OVERLAP and share(of_a) >= OVERLAP or share(of_q | of_a) >= OVERLAP:
                out += [(i, key, round(score, 9), round(share(of_q), 9), round(share(of_a), 9)) for key in keys[k]]
    return Counter(out)


@pytest.mark.parametrize("shard_items", [1000, 7])
def test_contaminated_is_what_brute_force_finds(spark, shard_items):
    import random

    from pyspark.sql import functions as F

    from orefield.llm.decontamination import contaminated

    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.8)) % 400}" for _ in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(f"i{k}", " ".join(words(rng.randint(3, 130))) + rng.choice([".", ". The end " + " ".join(words(4)), ""])) for k in range(60)]
    items += [("copy", items[5][1]), ("i5", items[5][1]), (None, items[6][1]), ("n", None), ("e", ""), ("e2", "...")]
    docs = []
    for i in range(120):
        text = words(rng.randint(0, 300))
        source = items[rng.randrange(60)][1].split()
        share = rng.choice([0, 0.5, 0.85, 0.95, 1])
        kept = [w if rng.random() < 0.97 + 0.03 * (share == 1) else "changed" for w in source[: int(len(source) * share)]]
        docs.append((f"d{i % 110}", " ".join(text[:20] + kept + text[20:])))
    docs += [(None, items[7][1]), ("five", items[5][1]), ("null", None), ("empty", ""), ("long", " ".join(words(30_000) + items[8][1].split() + words(3000)))]
    made = spark.createDataFrame(docs, "doc_id string, text string").withColumns({c: F.lit(c) for c in ("id", "at", "i", "x", "item_id")})
    bench = spark.createDataFrame(items, "item_id string, text string").withColumns({c: F.lit(c) for c in ("at", "i", "x", "shard")})
    got = contaminated(made, bench, shard_items=shard_items).collect()
    want = plain_contaminated(docs, items)
    assert Counter((r.doc_id, r.item_id, round(r.score, 9), round(r.question_overlap, 9), round(r.answer_overlap, 9)) for r in got) == want
    assert len(want) > 40 and {"copy", None} <= {k[1] for k in want}


# url filter


def test_url_parts_and_rules(spark):
    from orefield.llm.queries import URL_RULES
    from orefield.llm.url_filter import url_verdicts

    urls = ["http://www.Example.COM/en/x?y#z", "https://a.example.com/en/1", "http://example.com/de/", "ftp://x.net/es/q", "http://x.net/en/", "http://y.org", "no scheme", None, "http://com/", "http://b.com?q=/en/", "a://b://c/d"]
    links = {4: '<a href="http://y.org/p">', 5: "<a href='//blocked.net/es/'> <a href=/local>"}
    pages = spark.createDataFrame([(i, u, links.get(i)) for i, u in enumerate(urls)] + [(50, "http://blocked.net/es/", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_verdicts(pages, URL_RULES).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("example.com", "/de/", "com/", "allow")
    assert got[3] == ("x.net", "/es/q", "net/es/", "block")
    assert got[4] == ("x.net", "/en/", None, "block")  # its host has blocked pages and links to who links to one
    assert got[5] == ("y.org", "", None, "block")  # it links to a blocked host
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("com", "/", "com/", "allow") and got[9][:3] == ("b.com", "", None) and got[10][:2] == ("b:", "//c/d")
    assert url_verdicts(pages.limit(0), URL_RULES).count() == 0


def test_spread_is_personalised_pagerank(spark):
    from orefield.llm.common import Scratch
    from orefield.llm.url_filter import spread

    edges = spark.createDataFrame([("t", "a", "b", 0.5), ("t", "a", "c", 0.5), ("t", "b", "c", 1.0), ("t", "c", "a", 1.0)], "kind string, a string, b string, share double")
    seeds = spark.createDataFrame([("t", "a", 1.0)], "kind string, host string, seed double")
    got = {r.host: r.score for r in spread(edges, seeds, Scratch(spark, "t"), rounds=60, tolerance=1e-9).collect()}
    p = {"a": 1.0, "b": 0.0, "c": 0.0}
    for _ in range(300):
        p = {"a": 0.15 + 0.85 * p["c"], "b": 0.85 * p["a"] / 2, "c": 0.85 * (p["a"] / 2 + p["b"])}
    assert all(abs(got[h] - p[h]) < 1e-4 for h in p)


def test_spread_reaches_every_host(spark):
    from orefield.llm.common import Scratch
    from orefield.llm.queries import URL_RULES
    from orefield.llm.url_filter import spread, url_verdicts
    from pyspark.sql import functions as F

    chain = [(i, f"http://h{i}.org", f"<a href='http://h{i + 1}.org/'>") for i in range(25)]
    pages = spark.createDataFrame([*chain, (25, "http://h25.org", "<a href='http://blocked.net/es/'>"), (50, "http://blocked.net/es/", "")], "page_id long, url string, html string")
    assert {r.verdict for r in url_verdicts(pages, URL_RULES).collect()} == {"block"}
    n = 130_000  # seeds: a first step moves no host by 1e-6
    host = lambda c: F.concat(F.lit(c), "id")
    seeds = spark.range(n).select(F.lit("t").alias("kind"), host("a").alias("host"), F.lit(1 / n).alias("seed"))
    step = lambda a, b: spark.range(n).select(F.lit("t").alias("kind"), host(a).alias("a"), host(b).alias("b"), F.lit(1.0).alias("share"))
    out = spread(step("a", "b").unionByName(step("b", "c")), seeds, Scratch(spark, "t"))
    assert out.filter("host like 'c%'").count() == n


# html


def test_main_texts(spark):
    from orefield.llm.html_extract import main_texts

    def page(body, n=1):
        return f"<html><body><nav><a href=x>menu</a></nav><div class='wrap w{n}'><div class='post-{n} content'>{body}</div><div class='comments'><p>reader comment {LONG}</p></div></div><aside>{LONG}</aside><footer>foot</footer>"

    html = [page(f"<h1>Title {i} &amp; more</h1><p>First   para\n{i} {LONG}<p>Second <b>bold</b> &lt;tag&gt;<script>if (a<b) x='</p>'</script>", i) for i in range(5)]
    html += [page("<p>tiny"), None, "", "plain text only", "<p>unclosed <b>bold<br>line</p><form>field</form>", "<article><header><h1>T</h1></header><p>" + "long " * 30_000 + "</article>"]
    pages = spark.createDataFrame([(i, "http://h.com/x" if i < 6 else None, h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_texts(pages).collect()}
    for i in range(5):
        assert got[i] == f"Title {i} & more\nFirst para {i} {LONG}\nSecond bold <tag>"
    assert got[5] == "tiny" and got[6] == got[7] == "" and got[8] == "plain text only"
    assert got[9] == "unclosed bold line" and got[10] == "T\n" + " ".join(["long"] * 30_000)
    assert all(r.n_chars == len(r.text) for r in main_texts(pages).collect())
    assert main_texts(pages.limit(0)).count() == 0


def test_main_texts_of_nested_sections(spark):
    from orefield.llm.html_extract import main_texts

    nav = "<div>" + "".join(f"<p><a href=/{i}>a link to page {i}</a></p>" for i in range(9)) + "</div>"
    a, b = "intro words " * 25, "body words " * 90
    html = [
        f"<body>{nav}<article><h1>T</h1><section class=intro><p>{a}</p></section><section class=body><p>{b}</p></section></article>{nav}",
        f"<body>{nav}<article><h1>T</h1><div><section><div><p>{a}</p></div></section><section><div><p>{b}</p></div></section></div></article>{nav}",
        f"<body>{nav}<div class=x><h1>T</h1><div class=s><p>{b}</p></div><div class=s2><p>{a}</p></div></div>{nav}",
    ]
    pages = spark.createDataFrame([(i, f"http://h{i}.com/x", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_texts(pages).collect()}
    assert got[0] == got[1] == f"T\n{a.strip()}\n{b.strip()}"
    assert "a link" in html[2] and got[2].split("\n")[:1] == ["T"] and a.strip() in got[2]
    # a host's ninth kind of page has its path too
    kinds = "abcdefghij"
    host = [(i, "http://h.com/x", f"<body><div class=z{k}><p>{b}{'more ' * (20 - i)}</p><section class=q{k}><p>{k} end</p></section></div>{nav}") for i, k in enumerate(kinds)]
    from orefield.llm.html_extract import host_paths

    paths = host_paths(spark.createDataFrame(host, "page_id long, url string, html string")).first().paths
    assert [p.split(">")[1] for p in paths] == [f"div.z{k}" for k in kinds]


NAV = "<div>" + "".join(f"<p><a href=/{i}>a link to page {i}</a></p>" for i in range(9)) + "</div>"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<body><form id='aspnetForm'><div>MENU</div><p>ART</p><input name=x></form></body>", None),
        ("<body><div class='elementor-widget-container'><p>ART</p></div><div class='widget'><p>side</p></div></body>", "ART"),
        ("<body><section class='social science'><p>ART</p></section></body>", "ART"),
        ("<body><script src='a.js' />alert('code')</script><p>ART</p></body>", "ART"),
        ("<body><script src='a.js' /><p>ART</p></body>", "ART"),
        ("<body><svg class=x/><p>ART</p><svg><text>label</text></svg></body>", "ART"),
        ("<body><div class=post><p>ART</p></div><section id='user-discussion'><p>ART</p></section></body>", "ART"),
        ("<div class='content with-sidebar'><h1>T</h1><p>ART</p><div class=sidebar><p>side</p></div></div>", "T\nART"),
        ("<body><article><p>ART</p></article><div class=comments><article class=comment-body><p>ART ART ART ART ART</p></article></div>", "ART"),
        ("<body><div class=x><p>ART</p></div><div class=comments><h3>Comments</h3><p>ART ART</p></div></body>", "ART"),
        ("<body><nav><a href=x>ART ART</a></nav><main><p>ART</p><div class=share>share this</div></main><aside>ART</aside><footer>foot</footer>", "ART"),
        ("<body><div hidden><p>ART</p></div><div class=cookie-notice>we use</div><p>ART</p></body>", "ART"),
        ("<p>a<table><tr><td>b<td>c</table>", "a\nb\nc"),
        ("<b>x</b>&nbsp;&amp;&#233;&lt;p&gt; y", "x &é<p> y"),
        ("<!-- <p>ART</p> --><p>a<!-- b", "a"),
        ("<p title='a>b'>c</p><p", "c"),
    ],
)
def test_page_shapes(source, want):
    from orefield.llm.html_extract import Page

    article = " ".join(["The article's text goes on and on."] * 12)
    got = Page(source.replace("ART", article).replace("MENU", NAV)).text()
    if want is None:  # links beside the text in the one container
        assert article in got.split("\n")
    else:
        assert got == want.replace("ART", article)


def test_the_vote_of_the_host_decides(spark):
    from orefield.llm.html_extract import Page, main_texts

    story, box = "story words " * 30, "words of a box " * 60
    nav = NAV * 3
    page = lambda i, s: f"<body>{nav}<div class=story><p>{i} {s}</p></div>{nav}<div class=box><p>{box} {i if i == 5 else ''}</p></div>{nav}</body>"
    html = [page(i, story * (4 if i < 5 else 1)) for i in range(6)]
    assert box.strip() in Page(html[5]).text() and "story" not in Page(html[5]).text()
    pages = spark.createDataFrame([(i, "http://h.com/x", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_texts(pages).collect()}
    assert got == {i: f"{i} {(story * (4 if i < 5 else 1)).strip()}" for i in range(6)}


def test_what_a_host_repeats_is_no_text(spark):
    from orefield.llm.html_extract import host_paths, main_texts

    body = "some more words of the text " * 12
    page = lambda i: f"<body><div class=post><h1>T{i}</h1><p>{i} {body}</p><div class=strip><p>Read the same on every page.</p></div><p>{body} {i}</p></div></body>"
    rows = [(i, "http://a.com/x", page(i)) for i in range(6)] + [(10 + i, "http://b.com/x", page(1)) for i in range(6)] + [(20 + i, "http://c.com/x", page(i)) for i in range(4)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows] + [(None, None, None, None, None), (0, "http://a.com/x", page(0), "again", 2)], "page_id long, url string, html string, host string, paths int")
    found = {r.host: (r.paths, r.boilerplate) for r in host_paths(pages).collect()}
    assert found["a.com"] == (["body>div.post"], ["body>div.post>div.strip"]) and found["b.com"][1] == found["c.com"][1] == []  # copies count once; four pages are too few
    got = main_texts(pages).collect()
    text = lambda i, more: "\n".join([f"T{i}", f"{i} {body.strip()}", *more, f"{body}{' ' if body[-1] != ' ' else ''}{i}"])
    strip = ["Read the same on every page."]
    want = [(i, text(i, [])) for i in range(6)] + [(10 + i, text(1, strip)) for i in range(6)] + [(20 + i, text(i, strip)) for i in range(4)] + [(None, ""), (0, text(0, []))]
    assert Counter((r.page_id, r.text) for r in got) == Counter(want)


def test_boilerplate_goes_however_long_it_is(spark):
    from orefield.llm.html_extract import main_texts

    notice, words = "all of this is printed on each page of this host " * 12, "words of the article that tell what has happened "
    page = lambda i, same: f"<body><div class=post><h1>T{i}</h1><p>{i} {words * 6}</p><div class=x1>{same}</div><p>{words * 5}{i}</p><div class=y>Imprint</div></div></body>"
    rows = [(i, "http://a.com/x", page(i, notice)) for i in range(12)]
    rows += [(20 + i, "http://b.com/x", f"<body><div class=post><div class=z>{notice}</div></div><div class=foot>{i}</div></body>") for i in range(6)]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == f"T{i}\n{i} {(words * 6).strip()}\n{words * 5}{i}"
    assert {got[20 + i] for i in range(6)} == {notice.strip()}  # one article on six pages is no boilerplate


def test_consensus_is_what_a_plain_loop_finds(spark):
    import random
    from urllib.parse import urlparse

    from orefield.llm.html_extract import Page, main_texts

    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(LONG.split()) for _ in range(n))

    def page():
        parts = [f"<div class={rng.choice(['a', 'b', 'c', 'ad', 'related'])}><p>{words(rng.randint(1, 60))}</p><section class=s{rng.randint(0, 2)}><p>{words(rng.randint(1, 40))}</p></section></div>" for _ in range(rng.randint(1, 5))]
        return f"<body>{NAV if rng.random() < 0.5 else ''}{rng.choice(['<article>', '<div class=wrap>', ''])}{NAV.join(parts)}</body>"

    rows = [(i, f"http://{rng.choice('pqr')}.com/{i}", page()) for i in range(60)]
    scores, seen = defaultdict(Counter), defaultdict(lambda: defaultdict(dict))
    for _, url, html in rows:
        p, host = Page(html), urlparse(url).hostname
        if best := p.best():
            scores[host][best.path] += p.unlinked(best) + 1
        for e in p.containers:
            seen[host][e.path][html] = "|".join(x for x, ok in zip(p.blocks[e.start : e.end], p.alive[e.start : e.end]) if ok)
    want = {}
    for i, url, html in rows:
        host = urlparse(url).hostname
        same = [k for k, v in seen[host].items() if not scores[host][k] and len(v) >= 5 and max(Counter(v.values()).values()) >= 0.8 * len(v)]
        want[i] = Page(html).text(sorted((k for k, v in scores[host].items() if v), key=lambda k: (-scores[host][k], k)), same)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in main_texts(pages).collect()} == want


# warc


def test_archives_round_trip(spark, tmp_path):
    import zipfile
    from urllib.parse import urlparse

    from pyspark.sql import functions as F

    from orefield.llm.warc_zip import read_archives, round_trip, write_archives

    body = ["<p>" + "same " * 40, "short", "short", None, "", "é" * 60, "\r\n\r\n" * 40, "x" * 3_000_000, "<p>" + "same " * 40]
    pages = spark.createDataFrame([(i, f"http://h/{i}", b) for i, b in enumerate(body)] + [(None, None, "y" * 150)], "page_id long, url string, html string")
    got = {r.page_id: r for r in round_trip(pages).collect()}
    assert len(got) == len(body) + 1
    for i, b in enumerate(body):
        raw = (b or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 0) if i == 8 else ("response", None))
    archives = write_archives(pages.withColumn("original", F.lit(1)), f"file://{tmp_path}/zip").cache()
    payloads = {r.page_id: r.payload for r in read_archives(archives, payloads=True).collect()}
    assert all(bytes(payloads[str(i)]) == (b or "").encode() for i, b in enumerate(body) if i != 8) and payloads["8"] is None and None in payloads
    for r in archives.collect():  # a stock reader agrees
        with zipfile.ZipFile(urlparse(r.archive).path) as z:
            assert z.testzip() is None and {x.compress_type for x in z.infolist()} == {zipfile.ZIP_STORED}
    assert round_trip(pages.limit(0)).count() == 0


def test_archives_of_many_runs_and_string_keys(spark, tmp_path):
    from pyspark.sql import functions as F

    from orefield.llm import warc_zip

    text = lambda i: "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(300 + i))
    keys = [f"a>b\r\n {i}é/" for i in range(40)] + ["", None, "a>b\r\n 3é/"]
    rows = [(k, None, text(i % 25)) for i, k in enumerate(keys)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string").withColumn("digest", F.lit(1)).withColumn("page", F.lit(2)).repartition(3)
    archives = warc_zip.write_archives(pages, f"file://{tmp_path}/zip").cache()
    out = warc_zip.read_archives(archives, run_bytes=900)
    assert sorted(map(str, out.collect())) == sorted(map(str, warc_zip.read_archives(archives).collect()))
    least = {}
    for k, _, t in rows:
        least[t] = min(filter(lambda x: x is not None, (k, least.get(t))), default=None)
    want = Counter((k, len(t), hashlib.sha256(t.encode()).hexdigest(), *(("response", None) if least[t] in (k, None) else ("revisit", least[t]))) for k, _, t in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()) == want
    assert out.rdd.getNumPartitions() > 4


def test_positions(spark):
    from pyspark.sql import functions as F

    from orefield.llm.common import Scratch, positions

    data = [(x, i) for i, x in enumerate([None, "é", "b", "a", "B", "", "z"] * 1 + [f"k{i:03d}" for i in range(300)])]
    got = positions(spark.createDataFrame(data, "src string, part int").repartition(7), F.col("src").asc_nulls_last(), Scratch(spark, "t"))
    order = sorted((x for x, _ in data if x is not None), key=lambda x: x.encode()) + [None]
    assert got.columns == ["src", "part", "position"] and [r.src for r in sorted(got.collect(), key=lambda r: r.position)] == order


# pipeline


STAGE_ROWS = [
    (1, "alpha beta " * 30, "en", "s", 5), (1, "alpha beta " * 30, "en", "s", 5), (None, None, None, None, None), (None, None, None, None, None), (3, "", "", "", 0),
    (None, "a text of its own without a number", "en", None, 7), (5, "w " * 60_000 + "end", "en", "t", 1),
]


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"])
def test_each_stage_takes_odd_rows(spark, name):
    from pyspark.sql import functions as F

    import corpus_pipeline

    stage, sf_dir = dict(corpus_pipeline.STAGES)[name], "/root/testdata/sf0.001"
    clash = ("id", "size", "row", "label", "target", "component_id", "n_lines", "kept_lines", "_id", "_drops", "score", "item_id")
    docs = table(spark, STAGE_ROWS).withColumns({c: F.lit(c) for c in clash})
    out = stage(spark, docs, sf_dir)
    rows = out.collect()
    if name == "mixing":
        assert set(docs.columns) < set(out.columns)
        taken = Counter((r.doc_id, r.text) for r in rows)
        size = {s: sum(len(words(t)) for _, t, _, x, _ in STAGE_ROWS if x == s) for s in ("s", "t", None, "")}
        for s in size:
            assert sum(len(words(r.text)) for r in rows if r.source == s) <= 2 * size[s]
        assert all(n <= 2 * sum(1 for x in STAGE_ROWS if x[:2] == k) for k, n in taken.items())
    else:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        once = name == "near_dedup"
        want = Counter(((i, t or None) for i, t, *_ in STAGE_ROWS))
        got = Counter((r.doc_id, r.text or None) for r in rows)
        assert got == (Counter([(1, STAGE_ROWS[0][1]), (3, None), (None, STAGE_ROWS[5][1]), (5, STAGE_ROWS[6][1])]) if once else want)
    assert all(r[c] == c for r in rows for c in clash)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_pipeline_stages_are_what_plain_loops_find(spark):
    import corpus_pipeline

    hot = "this is a line of over forty code points in many documents"
    copies = " ".join(f"c{j}" for j in range(80))
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").filter("length(text) > 40").first().text
    data = [(i, f"{hot}\nown{i} " + " ".join(f"w{i}x{j}" for j in range(20)), "en", "s", 1) for i in range(6)]
    data += [(10, copies, "en", "s", 1), (11, copies + " more", "en", "t", 1), (12, f"before {item} after", "en", "t", 1), (13, " ".join(f"z{j}" for j in range(50)), "en", "t", 1)]
    docs, sf_dir, stages = table(spark, data), "/root/testdata/sf0.001", dict(corpus_pipeline.STAGES)
    lines = {r.doc_id: (r.text, r.n_chars) for r in stages["line_dedup"](spark, docs, sf_dir).collect()}
    for i, t, *_, n in data:
        left = t.split("\n", 1)[1] if i < 5 else t
        assert lines[i] == (left, len(left) if i < 5 else n)
    assert {r.doc_id for r in stages["near_dedup"](spark, docs, sf_dir).collect()} == {i for i, *_ in data} - {11}
    assert {r.doc_id for r in stages["decontamination"](spark, docs, sf_dir).collect()} == {i for i, *_ in data} - {12}
    mixed = stages["mixing"](spark, docs, sf_dir).collect()
    size = Counter()
    for _, t, _, s, _ in data:
        size[s] += len(words(t))
    total, want = 1.5 * sum(size.values()), {}
    want["s"] = min(2 * size["s"], total * 5 / 7)
    want["t"] = min(2 * size["t"], total - want["s"])
    for s in size:
        assert abs(sum(len(words(r.text)) for r in mixed if r.source == s) - want[s]) <= max(len(words(t)) for *_, t, _, x, _ in [(0, *d) for d in data] if x == s) / 2 + 1e-6


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(docs.columns) <= set(out.columns)
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    taken = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert taken and set(taken) <= ids and max(taken.values()) <= 2

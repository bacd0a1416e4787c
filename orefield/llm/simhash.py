r"""Near copies by SimHash fingerprints and covering locality-sensitive hashing.

Each bit position gets a vector of radius + 1 bits, none of them zero. For every such non-zero vector v there is one
table, whose mask holds the positions whose vector has an odd product with v. The positions in which two
fingerprints differ, at most radius of them, are that many linear conditions on v in radius + 1 dimensions, so some
v meets them all: the two agree on that whole mask and collide in its table (Pagh, CoveringLSH, 2016). Nothing
within the radius is missed. For radius 3 there are 15 masks of 32 to 36 bits.

Documents with one fingerprint are one class. Classes that share a bucket are compared in blocks of BLOCK, so a
bucket of any size is dealt out over tasks; a block hands on a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import starmap

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, ship, words_of
from .components import components

RADIUS, BLOCK, SEED = 3, 512, 42


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2 ** (radius + 1) - 1 masks; any two words that differ in at most radius bits agree on one of them."""
    vectors = 2 ** (radius + 1) - 1
    of_bit = [1 + (i * 7) % vectors for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (of_bit[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def fingerprint(words: list[bytes], size: int) -> int:
    """Bit k is set if it is set in over half of the hashes of the shingles, repeats included; no words: 0."""
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    n = max(1, len(words) - size + 1)
    hashed = np.fromiter(map(_hash, shingles), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        part = np.unpackbits(hashed[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in range(64) if 2 * ones[k] > n)


def _hash(shingle: bytes) -> int:
    return xxhash.xxh64_intdigest(shingle, SEED)


def fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary() if pa.types.is_string(batch.column(1).type) else pa.large_binary())
            fps = np.fromiter((fingerprint(words_of(t.as_py() or b""), size) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.record_batch({"id": batch.column(0), "fp": pa.array(fps.view(np.int64))})

    return run


class Forest:
    """Labels of the rows in hand; the label is the smallest row of those linked so far."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def links(radius: int, similarity: float | None = None, first_band: int = 0):
    """From rows sorted by group (t, k, lo, hi), each group whole in its partition: a forest of the links in each group.

    With a similarity, a pair also needs sketches that agree in MARGIN more than that share of their values. A group of a
    band's bucket (t is first_band or more) with pairs that are within MARGIN of it and not in one tree also gives one
    row without a and b, for the sketches can't decide on these.
    """

    def near(fp: np.ndarray, sketch: np.ndarray | None, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs link, and which may."""
        ok = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        maybe = np.zeros(len(ok), dtype=bool)
        if sketch is not None and ok.any():
            at = np.flatnonzero(ok)
            for part in np.array_split(at, -(-len(at) // 4096)):
                alike = sketched_similarity(sketch[i[part]], sketch[j[part]])
                ok[part] = alike >= similarity + MARGIN
                maybe[part] = (alike >= similarity - MARGIN) & ~ok[part]
        return ok, maybe

    def linked(fp: np.ndarray, sketch: np.ndarray | None, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that are linked to an earlier row, and the first row of their tree; then a row of each group with pairs that may link."""
        forest, label = Forest(len(fp)), np.arange(len(fp))
        unsure: list[np.ndarray] = []
        for d in range(1, len(fp)):
            same = group[d:] == group[:-d]
            if not same.any():
                break
            i = np.flatnonzero(same & (label[d:] != label[:-d]))
            if len(i):
                ok, maybe = near(fp, sketch, i, i + d)
                if maybe.any():
                    unsure.append(np.stack([i[maybe], i[maybe] + d]))
                i = i[ok]
            if len(i):
                for x in i.tolist():
                    forest.link(x, x + d)
                label = np.fromiter(map(forest.root, range(len(fp))), dtype=np.int64, count=len(fp))
        rows = np.flatnonzero(label != np.arange(len(fp)))
        i, j = np.concatenate(unsure, axis=1) if unsure else np.zeros((2, 0), dtype=np.int64)
        open_groups = np.unique(group[i[label[i] != label[j]]])
        return rows, label[rows], np.searchsorted(group, open_groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = held_sketch = None
        for last, batch in with_last(batches):
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "k", "lo", "hi", "id", "fp")])
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, SKETCH) if similarity else None
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
                sketch = np.concatenate([held_sketch, sketch]) if similarity else None
            ends = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1
            cut = rows.shape[1] if last else (int(ends[-1]) if len(ends) else 0)
            held, held_sketch = rows[:, cut:], sketch[cut:] if similarity else None
            if not cut:
                continue
            group = np.zeros(cut, dtype=np.int64)
            group[ends[ends < cut]] = 1
            a, b, unsure = linked(rows[5, :cut].view(np.uint64), sketch[:cut] if similarity else None, group.cumsum())
            unsure = unsure[rows[0, unsure] >= first_band]
            none = pa.nulls(len(unsure), pa.int64())
            yield pa.record_batch({
                "a": pa.concat_arrays([pa.array(rows[4, a]), none]), "b": pa.concat_arrays([pa.array(rows[4, b]), none]),
                "t": pa.array(rows[0, np.concatenate([a, unsure])].astype(np.int32)), "k": pa.array(rows[1, np.concatenate([a, unsure])]),
            })

    return run


def with_last(items: Iterator) -> Iterator[tuple[bool, object]]:
    """Each item, and whether it is the last."""
    items = iter(items)
    try:
        now = next(items)
    except StopIteration:
        return
    for after in items:
        yield False, now
        now = after
    yield True, now


def near_links(nodes: DataFrame, scratch: Scratch, *, radius: int = RADIUS, block: int = BLOCK, similarity: float | None = None) -> DataFrame:
    """Edges a, b (and t, k of where they meet) that connect whatever nodes have a fingerprint within the radius.

    nodes: id (distinct longs), fps (array of longs, as many in each row). With a similarity also sketch (binary) and
    bands (array of longs, as many in each row): nodes that share a band meet too, sketches decide on all that meet,
    and buckets of bands in which they can't decide come as t and k, without a and b.
    """
    masks = [m - 2**64 if m >= 2**63 else m for m in covering_masks(radius)]
    n = nodes.select(F.max(F.size("fps"))).first()[0] or 0
    tables = [F.struct(F.lit(j * len(masks) + t).alias("t"), F.element_at("fps", j + 1).bitwiseAND(F.lit(m)).alias("k")) for j in range(n) for t, m in enumerate(masks)]
    if similarity:
        bands = nodes.select(F.max(F.size("bands"))).first()[0] or 0
        tables += [F.struct(F.lit(n * len(masks) + j).alias("t"), F.element_at("bands", j + 1).alias("k")) for j in range(bands)]
    keys = nodes.select("id", F.explode(F.array(*tables)).alias("x")).select("id", "x.t", "x.k") if n else nodes.select("id", F.lit(0).alias("t"), F.lit(0).cast("long").alias("k"))
    shared = scratch.written(keys.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    # a band has no fingerprint: there all that meet are compared
    fp = F.when(F.col("t") < n * len(masks), F.get("fps", F.floor(F.col("t") / len(masks)).cast("int"))).otherwise(0).alias("fp")
    dealt = in_blocks(keys, shared, block).join(nodes, "id").select("t", "k", "lo", "hi", "id", fp, *(["sketch"] if similarity else []))
    group = ["t", "k", "lo", "hi"]
    return dealt.repartition(*group).sortWithinPartitions(*group, "id").mapInArrow(links(radius, similarity, n * len(masks)), "a long, b long, t int, k long")


def in_blocks(keys: DataFrame, buckets: DataFrame, block: int) -> DataFrame:
    """t, k, lo, hi, id for keys (id, t, k) in the buckets (t, k, n): a bucket's rows are dealt into blocks, and each pair of blocks is a group."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    return (
        keys.join(buckets, ["t", "k"])
        .select("t", "k", "id", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("t", "k", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "id")
    )


def simhash_components(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 3, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: key, fp (long), component_id (smallest key reachable over links, itself included).

    Texts are whole and A-Z lower-cased; fewer words than a shingle count as one shingle; null, empty and blank texts
    have fingerprint 0 and link like any other. Keys have any type and may repeat; a null key is never the smallest
    unless all are null. Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "simhash")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    prints = scratch.written(rows.mapInArrow(fingerprints(shingle), f"id {kind}, fp long"), "prints")
    classes = scratch.written(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    # nodes are fingerprints; a component is named by the smallest id of its classes
    nodes = classes.select(F.col("fp").alias("id"), F.array("fp").alias("fps"))
    roots = components(near_links(nodes, scratch, radius=radius, block=block), scratch)
    rooted = scratch.written(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    named = scratch.written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    of_class = scratch.written(rooted.join(named, "root").select("fp", "component_id"), "of-class")
    return prints.join(of_class, "fp").select(F.col("id").alias(key), "fp", "component_id")


#: For near copies by similarity: fingerprints of a document's distinct words, each with its own seed; bins of its sketch.
PRINTS, SKETCH = 8, 512
#: Bands of a min-hash of its shingles, and values in each: a pair of similarity s misses them all with probability (1 - s ** ROWS) ** BANDS, 7e-5 at 0.8.
BANDS, ROWS = 24, 5
#: A sketch that is further than this from the asked similarity decides by itself (four standard deviations); where nearer ones meet, sets are counted exactly, in blocks of so many rows.
MARGIN, EXACT_BLOCK = 0.07, 2048


_RANDOM = np.random.default_rng(SEED)
_XORS, _ODDS = (_RANDOM.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
_ODDS |= np.uint64(1)
_MIX = _RANDOM.integers(0, 2**64, ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than a shingle count as one."""
    grams = set(map(b" ".join, zip(*(words[i:] for i in range(size))))) if len(words) >= size else {b" ".join(words)}
    return np.unique(np.fromiter(map(_hash, grams), dtype=np.uint64, count=len(grams)))


def bands_of(hashed: np.ndarray) -> list[int]:
    """BANDS hashes of ROWS min-hash values each."""
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashed), 512):  # small enough for the cache
        x = (hashed[at : at + 512] ^ _XORS) * _ODDS
        x ^= x >> np.uint64(32)
        x *= _ODDS
        np.minimum(least, x.min(axis=1), out=least)
    least ^= least >> np.uint64(29)
    mixed = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64).tolist()


def sketch_of(hashed: np.ndarray) -> bytes:
    """One-permutation min-hash: hashes of shingles fall into SKETCH bins, of each bin one byte of its smallest hash (1 to 255); 0 is an empty bin."""
    least = np.full(SKETCH, 2**64 - 1, dtype=np.uint64)
    np.minimum.at(least, (hashed % np.uint64(SKETCH)).astype(np.int64), hashed // np.uint64(SKETCH))
    return np.where(least == np.uint64(2**64 - 1), 0, least % np.uint64(255) + np.uint64(1)).astype(np.uint8).tobytes()


def sketched_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard by rows: equal bins of those that aren't empty in both (Li, Owen and Zhang, 2012); nearly exact for sets smaller than the bins."""
    some = (a != 0) | (b != 0)
    return ((a == b) & some).sum(axis=1) / np.maximum(some.sum(axis=1), 1)


def word_prints(words: list[bytes]) -> list[int]:
    """PRINTS fingerprints of the distinct words: few words change in a near copy, and few bits with them."""
    hashed = np.fromiter(map(_hash, dict.fromkeys(words)), dtype=np.uint64)
    out = []
    for seed in range(PRINTS):
        x = (hashed ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
        ones = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(sum(1 << k for k in range(64) if 2 * ones[k] > len(x)))
    return out


def near_prints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, fps, sketches, bands = [], [], [], []
            for t in batch.column(1):
                words = words_of((t.as_py() or "").encode())
                digest.append(xxhash.xxh3_128_digest(b" ".join(words)))
                fps.append([x - 2**64 if x >= 2**63 else x for x in word_prints(words)])
                hashed = shingle_hashes(words, size)
                sketches.append(sketch_of(hashed))
                bands.append(bands_of(hashed))
            yield pa.record_batch({
                "id": batch.column(0), "digest": pa.array(digest, pa.binary()),
                "fps": pa.array(fps, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.binary()),
                "bands": pa.array(bands, pa.list_(pa.int64())),
            })

    return run


def shingle_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of((t.as_py() or "").encode()) for t in batch.column(0)]
            yield pa.record_batch({
                "digest": pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary()),
                "shingles": pa.array([np.unique(shingle_hashes(w, size).astype(np.uint32)).tobytes() for w in words], pa.binary()),
            })

    return run


def exact_links(similarity: float):
    """Of a group of rows (id, root, shingles): a forest of the links between different roots, by exact Jaccard of the sets.

    For each row one count over the lists of rows that have its shingles gives its overlap with every other.
    """

    def run(group: pa.Table) -> pa.Table:
        ids, roots = group.column("id").to_numpy(), group.column("root").to_numpy()
        sets = [np.frombuffer(x, np.uint32) for x in group.column("shingles").to_pylist()]
        sizes = np.array(list(map(len, sets)))
        forest = Forest(len(ids))
        first: dict[int, int] = {}
        for i, r in enumerate(roots.tolist()):
            forest.link(i, first.setdefault(r, i))
        values, code = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(code, kind="stable")]
        ends = np.cumsum(np.bincount(code, minlength=len(values)))
        starts, at, left, edges = np.concatenate([[0], ends[:-1]]), 0, len(first), []
        for i, n in enumerate(sizes.tolist()):
            mine, at = code[at : at + n], at + n
            if left == 1:
                break
            many = ends[mine] - starts[mine]
            where = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            both = np.bincount(owner[where], minlength=len(sets))
            for j in np.flatnonzero(both >= similarity * (n + sizes - both)).tolist():
                if forest.root(i) != forest.root(j):
                    forest.link(i, j)
                    edges.append((i, j))
                    left -= 1
        a, b = np.array(edges, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"a": ids[a], "b": ids[b]})

    return run


def decided(buckets: DataFrame, nodes: DataFrame, first_band: int, roots: DataFrame, rows: DataFrame, classes: DataFrame, scratch: Scratch, *, shingle: int, similarity: float) -> DataFrame:
    """Edges a, b that connect what has that Jaccard similarity within the buckets (t, k) of bands.

    rows: id, text; classes: digest, least, node. Buckets in which all nodes have one root already need nothing.
    """
    bands = nodes.select("id", F.posexplode("bands").alias("t", "k")).withColumn("t", F.col("t") + first_band)
    members = scratch.written(bands.join(buckets.distinct(), ["t", "k"]).join(roots.withColumnRenamed("node", "id"), "id", "left").select("t", "k", "id", F.coalesce("root", "id").alias("root")), "members")
    still_open = scratch.written(members.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("t", "k", "n"), "open")
    members = scratch.written(in_blocks(members.select("id", "t", "k"), still_open, EXACT_BLOCK), "dealt")
    asked = scratch.written(members.select(F.col("id").alias("node")).distinct().join(classes, "node"), "asked")
    # of rows with the smallest key of a class, those with its words
    found = rows.join(asked, F.col("id").eqNullSafe(F.col("least")), "left_semi").select("text").mapInArrow(shingle_sets(shingle), "digest binary, shingles binary")
    sets = scratch.written(found.join(asked.select("digest", F.col("node").alias("id")), "digest").dropDuplicates(["id"]).select("id", "shingles"), "sets")
    full = members.join(sets, "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    return full.groupBy("t", "k", "lo", "hi").applyInArrow(exact_links(similarity), "a long, b long")


def near_copies(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """key and component_id (the smallest key of its group) of each row of docs.

    Rows with the same words are one class. Classes meet if they share a band of min-hashes of their shingles or if one
    of their PRINTS fingerprints of distinct words is within the radius, and link if the Jaccard similarity of their
    shingle sets is so high: by sketch where that is clear, else by the whole sets (32-bit hashes of shingles) of all that
    share the band. Groups are connected components.
    Null, empty and blank texts are one class. Keys have any type and may repeat; a null key is never the smallest unless
    all are null. Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "near-copies")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    made = rows.mapInArrow(near_prints(shingle), f"id {kind}, digest binary, fps array<long>, sketch binary, bands array<long>")
    prints = scratch.written(made.withColumn("node", F.monotonically_increasing_id()), "prints")
    classes = scratch.written(prints.groupBy("digest").agg(F.min("id").alias("least"), F.min("node").alias("node")), "classes")
    nodes = scratch.written(prints.join(classes.select("node"), "node", "left_semi").select(F.col("node").alias("id"), "fps", "sketch", "bands"), "nodes")
    met = scratch.written(near_links(nodes, scratch, radius=radius, block=block, similarity=similarity), "met")
    roots = scratch.written(components(met.filter("a is not null").select("a", "b"), scratch), "roots")
    first_band = PRINTS * len(covering_masks(radius))
    links = decided(met.filter("a is null").select("t", "k"), nodes, first_band, roots, rows, classes, scratch, shingle=shingle, similarity=similarity)
    roots = components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), scratch)
    rooted = scratch.written(classes.join(roots, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.written(rooted.join(named, "root").select("digest", "component_id"), "named")
    scratch.drop(nodes)
    scratch.drop(met)
    return prints.select("id", "digest").join(named, "digest").select(F.col("id").alias(key), "component_id")


def without_near_copies(docs: DataFrame, *, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs with one row of each group of near copies: that with the smallest key, a null key last; of rows with one key, one.

    Rows get a number of their own, so rows that repeat, or whose key does, are judged one by one. All columns stay.
    """
    scratch = Scratch(docs.sparkSession, "without-near-copies")
    row = fresh(docs, "row")
    rows = scratch.written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_copies(rows, text=text, key=row, **options).withColumnRenamed(row, "of")
    many = scratch.written(groups.join(groups.filter(F.col("of") != F.col("component_id")).select("component_id").distinct(), "component_id"), "groups")
    keyed = many.join(rows.select(F.col(row).alias("of"), F.col(key).alias("key")), "of")
    order = F.struct(F.col("key").isNull(), "key", "of")
    stays = keyed.groupBy("component_id").agg(F.min_by("of", order).alias("of")).select("of")
    gone = scratch.written(many.select(F.col("of").alias(row)).join(stays.withColumnRenamed("of", row), row, "left_anti"), "gone")
    return rows.join(gone, row, "left_anti").select(docs.columns)

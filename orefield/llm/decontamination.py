r"""Benchmark decontamination: a BM25 inverted index of the test items, queried by every passage of every document.

The index holds parts of items (PART words at most) with impacts that are a part's BM25 weights divided by their sum,
so a passage that holds all of a part scores 1. Posting lists are cut into blocks of BLOCK with their largest impact.
A passage is 2 * PART words and starts every PART words, so a run of PART words lies whole in one of them.

All passages of a batch are first screened together against a safe bound (the impacts of their rarer terms, plus
all that the commonest terms could add); block-max WAND (Ding and Suel, 2011) then finds, for each passage that is
left, every part that scores THRESHOLD or more. Items found so are verified on the whole document: of the five-word
shingles of the question and of those that end in the answer, or of those of the whole item, at least OVERLAP must be
in the document.

Items with the same text are indexed once. Document frequencies, the number of parts and their mean length are counted
over all items; each shard of the index, of bounded size, is built with them in a task of its own and written to the
shared folder, so that results don't depend on shards and nothing of the benchmark passes through the driver. The
documents are read once, without a shuffle: a worker holds up to HELD shards, and reads others for each group of texts.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Mapping
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh, ship

PART, BLOCK, THRESHOLD, OVERLAP, SHINGLE = 48, 32, 0.5, 0.8, 5
K1, B = 1.2, 0.75
#: Most items, and code points of items, in one shard of the index (about 10 bytes of index a code point).
SHARD_ITEMS, SHARD_CHARS = 20_000, 8_000_000
#: Shards that a worker keeps in memory.
HELD = 4
#: The end of a sentence or a line, after which an answer can begin.
BREAK = re.compile(r"(?:[.!?]\s+|\n+)(?=\S)")


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the item up to its last sentence or line, and of that; where there is one only, its last third is the answer."""
    breaks = [m.end() for m in BREAK.finditer(text) if text[m.end() :].strip()]
    for at in reversed(breaks):
        q, a = tokens(text[:at]), tokens(text[at:])
        if q and a:
            return q, a
    words = tokens(text)
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def shingles(words: list[str], size: int = SHINGLE) -> list[tuple[str, ...]]:
    return list(zip(*(words[i:] for i in range(size)))) if len(words) >= size else [tuple(words)] if words else []


def parts_of(words: list[str]) -> list[list[str]]:
    """The words in as few runs of PART words at most as can be, of even sizes."""
    n = -(-len(words) // PART)
    return [words[i * len(words) // n : (i + 1) * len(words) // n] for i in range(n)]


class Index:
    """Parts of items with block-max posting lists.

    df, n_parts and mean are the document frequencies, the number and the mean length of parts in all shards; where they
    aren't given, the items are all there are.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, df: Mapping[str, int] | None = None, n_parts: int = 0, mean: float = 0.0):
        self.threshold = threshold
        self.ids, self.question, self.answer, part_item, parts = [], [], [], [], []
        for key, text in items:
            q, a = question_and_answer(text or "")
            words = q + a
            if not words:
                continue
            grams = shingles(words)
            first = max(0, len(q) - SHINGLE + 1)
            self.question.append(set(grams[:first]) or set(grams))
            self.answer.append(set(grams[first:]))
            of_item = list(map(Counter, parts_of(words)))
            part_item += [len(self.ids)] * len(of_item)
            parts += of_item
            self.ids.append(key)
        self.part_item = part_item
        here = Counter(t for p in parts for t in p)
        if df is None:
            df, n_parts, mean = here, len(parts), sum(sum(p.values()) for p in parts) / max(1, len(parts))
        self.vocabulary = {t: k for k, (t, _) in enumerate(sorted(here.items(), key=lambda x: (x[1], x[0])))}  # rarest first
        lists: list[list[tuple[int, float]]] = [[] for _ in here]
        for p, part in enumerate(parts):
            size = sum(part.values())
            w = {t: math.log(1 + (n_parts - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean)) for t, n in part.items()}
            total = sum(w.values())
            for t, x in w.items():
                lists[self.vocabulary[t]].append((p, x / total))
        self.parts = [np.array([p for p, _ in x], dtype=np.int64) for x in lists]
        self.impacts = [np.array([u for _, u in x]) for x in lists]
        self.block_max = [np.maximum.reduceat(u, np.arange(0, len(u), BLOCK)) for u in self.impacts]
        self.most = np.array([u.max() for u in self.impacts])
        # the commonest terms (in over a twentieth of the parts, and in more than eight) are only bounded in the screen, as long as they leave it most of every part's score
        self.n_rare = sum(n <= max(8, len(parts) // 20) for n in here.values())
        self.common_rest = np.zeros(len(parts))
        for k in range(len(lists) - 1, self.n_rare - 1, -1):
            self.common_rest[self.parts[k]] += self.impacts[k]
            if self.common_rest.max() > self.threshold / 2:
                self.common_rest[self.parts[k]] -= self.impacts[k]
                self.n_rare = k + 1
                break
        sizes = np.array([len(x) for x in self.parts[: self.n_rare]], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.flat_parts = np.concatenate([*self.parts[: self.n_rare], np.zeros(0, np.int64)])
        self.flat_impacts = np.concatenate([*self.impacts[: self.n_rare], np.zeros(0)])

    def screen(self, passage: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Passages that may reach the threshold, from pairs of passage and term id (any order, repeats allowed)."""
        if not len(self.flat_parts):
            return np.unique(passage)
        n_terms = len(self.vocabulary)
        rare = term < self.n_rare
        pairs = np.unique(passage[rare] * n_terms + term[rare])
        p, t = pairs // n_terms, pairs % n_terms
        n = self.starts[t + 1] - self.starts[t]
        at = np.repeat(self.starts[t] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        key = np.repeat(p, n) * len(self.part_item) + self.flat_parts[at]
        cells, where = np.unique(key, return_inverse=True)
        sums = np.bincount(where, weights=self.flat_impacts[at], minlength=len(cells))
        ok = sums + self.common_rest[cells % len(self.part_item)] >= self.threshold - 1e-9
        return np.unique(cells[ok] // len(self.part_item))

    def wand(self, terms: list[int]) -> dict[int, float]:
        """Every part whose score for the set of terms reaches the threshold, with the score."""
        least = self.threshold - 1e-9
        found, end = {}, len(self.part_item)
        cursors = [[int(self.parts[t][0]), t, 0] for t in set(terms)]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                bound += self.most[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            # the largest impacts of the blocks that would hold doc, and where the first of these blocks ends
            bound, until = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
            for at, t, i in cursors[: pivot + 1]:
                parts = self.parts[t]
                j = i if at >= doc else i + int(np.searchsorted(parts[i:], doc))
                if j < len(parts):
                    b = j // BLOCK
                    bound += self.block_max[t][b]
                    until = min(until, int(parts[min(len(parts), (b + 1) * BLOCK) - 1]) + 1)
            if bound >= least:
                if cursors[0][0] == doc:
                    score = sum(float(self.impacts[t][i]) for _, t, i in cursors[: pivot + 1])
                    if score >= least:
                        found[doc] = score
                    target = doc + 1
                else:
                    target = doc
            else:
                target = max(until, doc + 1)
            moved = []
            for c in cursors[: pivot + 1]:
                parts = self.parts[c[1]]
                if c[0] < target:
                    c[2] += int(np.searchsorted(parts[c[2] :], target))
                if c[2] < len(parts):
                    c[0] = int(parts[c[2]])
                    moved.append(c)
            cursors = moved + cursors[pivot + 1 :]
        return found

    def verified(self, item: int, grams: set) -> tuple[float, float, bool]:
        """Overlap of the question and of the answer, and whether these or the whole item's are enough."""
        q, a = self.question[item], self.answer[item]
        in_q, in_a = len(q & grams), len(a & grams)
        of_q, of_a = in_q / len(q), in_a / len(a) if a else 1.0
        return of_q, of_a, min(of_q, of_a) >= OVERLAP or len((q | a) & grams) >= OVERLAP * len(q | a)

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item id, best score, question overlap, answer overlap) of what is verified."""
        get = self.vocabulary.get
        rows, first, passage, term, n_passages = [], [0], [], [], 0
        for text in texts:
            words = tokens(text)
            ids = np.fromiter(map(get, words, repeat(-1)), dtype=np.int64, count=len(words))
            rows.append((words, ids))
            at = np.flatnonzero(ids >= 0)
            passage.append(at // PART + n_passages)
            term.append(ids[at])
            n_passages += len(words) // PART + 1
            first.append(n_passages)
        passage, term = np.concatenate(passage), np.concatenate(term)
        back = passage > 0  # a word of stretch j is in passages j and j - 1; where that is another row's, it is screened in vain
        kept = self.screen(np.concatenate([passage, passage[back] - 1]), np.concatenate([term, term[back]]))
        row_of = np.searchsorted(first, kept, side="right") - 1
        for row in np.unique(row_of).tolist():
            words, ids = rows[row]
            best: dict[int, float] = {}
            for j in (kept[row_of == row] - first[row]).tolist():
                here = ids[j * PART : (j + 2) * PART]
                for part, score in self.wand(here[here >= 0].tolist()).items():
                    item = self.part_item[part]
                    best[item] = max(score, best.get(item, 0.0))
            if best:
                grams = {g for n in {SHINGLE, *(len(next(iter(self.question[i]))) for i in best)} for g in shingles(words, n)}
                for item, score in sorted(best.items()):
                    q, a, enough = self.verified(item, grams)
                    if enough:
                        yield row, self.ids[item], score, q, a


#: Code points of texts that are screened together.
TOGETHER = 2_000_000


def item_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part of each item its shard, its length and its distinct terms."""
    for batch in batches:
        rows = [(shard, len(part), sorted(set(part))) for shard, text in zip(*(c.to_pylist() for c in batch.columns)) for part in parts_of([w for half in question_and_answer(text) for w in half])]
        shard, size, terms = zip(*rows) if rows else ((), (), ())
        yield pa.record_batch({"shard": pa.array(shard, pa.int32()), "size": pa.array(size, pa.int32()), "terms": pa.array(terms, pa.list_(pa.string()))})


def shard_built(base: str, threshold: float, n_parts: int, mean: float):
    """Write the index of a shard, from its items and the frequencies of their terms; a second attempt renames over the first."""

    def run(key: tuple, items: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
        df = dict(zip(terms["term"], terms["df"].astype(int)))
        index = Index(sorted(zip(items["at"].astype(int), items["x"])), threshold, df, n_parts, mean)
        fs, folder = pafs.FileSystem.from_uri(base)
        fs.create_dir(folder, recursive=True)
        hidden, name = f"{folder}/_{uuid.uuid4().hex}.tmp", f"shard-{key[0]:06d}.pickle"
        with fs.open_output_stream(hidden) as out:
            out.write(pickle.dumps(index))
        fs.move(hidden, f"{folder}/{name}")
        return pd.DataFrame({"path": [f"{base}/{name}"]})

    return run


_held: dict[str, Index] = {}


def loaded(path: str) -> Index:
    index = _held.pop(path, None)
    if index is None:
        fs, name = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(name) as f:
            index = pickle.loads(f.read())
        while len(_held) >= HELD:
            _held.pop(next(iter(_held)))
    _held[path] = index
    return index


def found(paths: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backwards = False
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                group, chars, start = [], 0, at
                while at < len(texts) and (not group or chars < TOGETHER):
                    group.append(texts[at].as_py())
                    chars += len(group[-1])
                    at += 1
                # to and fro, so the shards in memory come first
                for path in reversed(paths) if backwards else paths:
                    out = list(loaded(path).matches(group))
                    if out:
                        row, item, score, q, a = zip(*out)
                        yield pa.record_batch({
                            "id": ids.take(pa.array([start + r for r in row], pa.int64())),
                            "at": pa.array(item, pa.int64()), "score": pa.array(score, pa.float64()),
                            "question_overlap": pa.array(q, pa.float64()), "answer_overlap": pa.array(a, pa.float64()),
                        })
                backwards = not backwards

    return run


def contaminated(
    docs: DataFrame, items: DataFrame, *, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, shard_items: int = SHARD_ITEMS, shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """One row per document and item that it holds: key, item_id, score, question_overlap, answer_overlap.

    Words are runs of letters, digits and underscores, lower-cased. Null and empty texts hold nothing; items without
    words are in nothing; items of under five words count as one shingle. Rows that repeat, on either side, give
    repeated rows; an empty table on either side gives none. Keys have any type and may be null; other columns are
    ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "decontamination")
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    result = f"{key} {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    given = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("x")).filter("x is not null").withColumn("at", F.xxhash64("x"))
    # texts with the same hash are one item, which needs the same text but for one pair in 2 ** 64
    wanted = given.groupBy("at").agg(F.min("x").alias("x"))
    wanted = scratch.written(wanted, "items")
    n, chars = wanted.agg(F.count("*"), F.coalesce(F.sum(F.length("x")), F.lit(0))).first()
    shards = max(1, -(-n // shard_items), -(-chars // shard_chars))
    wanted = wanted.withColumn("shard", F.pmod("at", F.lit(shards)).cast("int"))
    parts = scratch.written(wanted.select("shard", "x").mapInArrow(item_parts, "shard int, size int, terms array<string>"), "parts")
    n_parts, mean = parts.agg(F.count("*"), F.avg("size")).first()
    if not n_parts:
        return spark.createDataFrame([], result)
    of_shard = parts.select("shard", F.explode("terms").alias("term")).groupBy("shard", "term").agg(F.count("*").alias("n"))
    of_shard = scratch.written(of_shard, "terms")
    df = of_shard.groupBy("term").agg(F.sum("n").alias("df"))
    terms = of_shard.select("shard", "term").join(df, "term")
    built = wanted.groupBy("shard").cogroup(terms.groupBy("shard")).applyInPandas(shard_built(f"{scratch.base}/index", threshold, n_parts, mean), "path string")
    paths = sorted(r["path"] for r in scratch.written(built, "shards").collect())
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("text is not null")
    hits = rows.mapInArrow(found(paths), f"id {kind}, at long, score double, question_overlap double, answer_overlap double")
    return hits.join(given.select("at", "i"), "at").select(F.col("id").alias(key), F.col("i").alias("item_id"), "score", "question_overlap", "answer_overlap")


def without_contaminated(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; rows get a number of their own, so keys may be null or repeat."""
    scratch = Scratch(docs.sparkSession, "without-contaminated")
    row = fresh(docs, "row")
    rows = scratch.written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = scratch.written(contaminated(rows, items, key=row, **options).select(row).distinct(), "found")
    return rows.join(found, row, "left_anti").select(docs.columns)

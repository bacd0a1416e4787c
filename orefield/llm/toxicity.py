r"""Toxicity by compression distance.

Zstandard dictionaries are trained on labelled texts: one on the windows of ordinary texts, one on those of each half of the
toxic texts. A window is compressed with each; its bare length and the two compressed ones are looked up in a table of log odds, which is
calibrated on labelled texts that the dictionaries measuring them have not seen. A logistic curve over what a document's windows give is its
score. Windows are WINDOW_WORDS words, tiled to TILE bytes so that the block is always entropy-coded; they cover all
words of a text, and each is compressed with all of them.

Most of a toxic text is ordinary. So the toxic texts are split in two halves, and their dictionaries are trained in
ROUNDS. In each round a dictionary of the one half measures the other half's windows. Windows whose lengths are far commoner in toxic than in ordinary
texts (log odds over PURE) are the toxic text of the next round. The lengths of the last round, each text measured by
the half that it isn't in, calibrate the log odds and the curve. A score takes the mean of what both halves give.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from math import log

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ship

#: Labelled rows of each class that training takes at most, with their whole texts; the one bound of the model.
SAMPLE = 2000
WINDOW_WORDS, TILE = 1, 64
#: Bytes of the dictionaries at most, and at least that much training text for each byte; segments and their parts as zstandard's trainer takes them.
ORDINARY, TOXIC, REFINED, TEXT_PER_BYTE, SEGMENT, PART = 131072, 65536, 16384, 2, 48, 8
ROUNDS, PURE = 4, 1.5
#: Bare lengths (bytes) from here on are one.
LONGEST = 24
#: Windows whose log odds a worker remembers, and the longest (in code points) that it remembers.
KEPT, KEPT_CHARS = 1_000_000, 60

Lengths = tuple[int, int, int]  # bare, under the ordinary dictionary, under the toxic one


def windows(text: str, size: int = WINDOW_WORDS) -> list[str]:
    """All words of the text (letters, digits and underscores) in runs of so many."""
    words = WORD.findall(text.lower())
    return words if size == 1 else [" ".join(words[i : i + size]) for i in range(0, len(words), size)]


def dictionary(samples: list[str], size: int) -> bytes | None:
    """A zstandard dictionary trained on windows; None where there is too little to train on."""
    raw = [f" {x} ".encode() for x in samples]
    random.Random(5).shuffle(raw)
    size = min(size, sum(map(len, raw)) // TEXT_PER_BYTE)
    if size < 256:  # the least that zstandard trains
        return None
    try:
        return zstd.train_dictionary(size, raw, k=SEGMENT, d=PART).as_bytes()
    except zstd.ZstdError:
        return None


class Ruler:
    """Compressed lengths of windows under one dictionary: bare frames, a lazy search with short matches."""

    def __init__(self, content: bytes):
        held = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_FULLDICT)
        params = zstd.ZstdCompressionParameters(
            format=zstd.FORMAT_ZSTD1_MAGICLESS, strategy=zstd.STRATEGY_LAZY2, window_log=19, chain_log=17, hash_log=17, search_log=5,
            min_match=4, target_length=32, write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        held.precompute_compress(compression_params=params)
        self.compress = zstd.ZstdCompressor(dict_data=held, compression_params=params).compress

    def length(self, window: str) -> int:
        return len(self.compress(tiled(window)))


def bare(window: str) -> int:
    return min(len(window.encode()), LONGEST)


def tiled(window: str) -> bytes:
    b = f" {window} ".encode()
    return b * max(1, -(-TILE // len(b)))


def measured(texts: Iterable[list[str]], ordinary: dict[str, int], toxic: Ruler) -> list[list[Lengths]]:
    """The lengths of each window of each text; ordinary has those under the ordinary dictionary."""
    texts = list(texts)
    found = {w: (bare(w), ordinary[w], toxic.length(w)) for w in set(chain.from_iterable(texts))}
    return [[found[w] for w in ws] for ws in texts]


class Odds:
    """How much commoner lengths are among the windows of toxic texts, and how much commoner toxic texts with such a window are."""

    def __init__(self, toxic: list[list[Lengths]], ordinary: list[list[Lengths]]):
        self.windows = [Counter(chain.from_iterable(x)) for x in (toxic, ordinary)]
        self.texts = [Counter(chain.from_iterable(map(set, x))) for x in (toxic, ordinary)]
        self.n_texts = [len(toxic), len(ordinary)]

    def table(self) -> dict[Lengths, tuple[float, float]]:
        return self.of(self.windows[0].keys() | self.windows[1].keys())

    def of(self, found: Iterable[Lengths], less: list[Lengths] = (), side: int = 0) -> dict[Lengths, tuple[float, float]]:
        """Both log odds of the lengths found, without the one text of a side (0 toxic, 1 ordinary) whose lengths are less."""
        own, n = Counter(less), [max(1, x.total()) for x in self.windows]
        n_texts = list(self.n_texts)
        if less:
            n[side], n_texts[side] = max(1, n[side] - len(less)), n_texts[side] - 1
        out = {}
        for c in found:
            w, t = [x[c] for x in self.windows], [x[c] for x in self.texts]
            w[side], t[side] = w[side] - own[c], t[side] - (c in own)
            out[c] = (log((w[0] + 2) / n[0] / ((w[1] + 2) / n[1])), log((t[0] + 1) / (n_texts[0] + 2) / ((t[1] + 1) / (n_texts[1] + 2))))
        return out

    def features_without(self, text: list[Lengths], side: int) -> list[float]:
        """What the text's windows give by the log odds of all other texts."""
        odds = self.of(set(text), text, side)
        return features([odds[c] for c in text])


@dataclass
class ToxicityModel:
    """base is the score of every text where a dictionary or the curve couldn't be trained."""

    base: float
    ordinary: bytes | None = None
    toxic: list[bytes] = field(default_factory=list)
    odds: list[dict[Lengths, tuple[float, float]]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    centre: list[float] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.open()

    def open(self) -> None:
        self._kept: dict[str, list[tuple[float, float]]] = {}
        self._rulers = [Ruler(x) for x in (self.ordinary, *self.toxic)] if self.ordinary and self.toxic else []

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.open()

    def lengths(self, window: str) -> list[Lengths]:
        """The window's lengths for each of the toxic dictionaries."""
        b = tiled(window)
        ordinary, *toxic = (len(r.compress(b)) for r in self._rulers)
        return [(bare(window), ordinary, x) for x in toxic]

    def window_odds(self, window: str) -> list[tuple[float, float]]:
        x = self._kept.get(window)
        if x is None:
            x = [odds.get(c, (0.0, 0.0)) for odds, c in zip(self.odds, self.lengths(window))]
            if len(self._kept) < KEPT and len(window) <= KEPT_CHARS:
                self._kept[window] = x
        return x

    def score(self, text: str) -> float:
        if not self.weights:
            return self.base
        by_dictionary = zip(*map(self.window_odds, windows(text))) if WORD.search(text) else [[]]
        x = np.mean([features(list(odds)) for odds in by_dictionary], axis=0)
        z = (x - self.centre) / self.spread
        return float(1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -35, 35))))


def features(odds: list[tuple[float, float]]) -> list[float]:
    """What a document's windows give: sums and largest values of their log odds."""
    by_window = np.array([x for x, _ in odds] or [0.0])
    by_document = sorted({y for _, y in odds})
    n = len(by_window)
    most = np.partition(by_window, -3)[-3:] if n > 3 else by_window
    return [by_window.sum(), by_window.mean(), most.sum(), np.log1p(n), np.maximum(by_window, 0).sum() / np.sqrt(n), sum(by_document[-3:])]


@dataclass
class Crossed:
    """A dictionary of one half of the toxic texts, and the lengths of the other half and of half of the ordinary texts."""

    content: bytes
    toxic: list[list[Lengths]]
    ordinary: list[list[Lengths]]

    def odds(self) -> Odds:
        return Odds(self.toxic, self.ordinary)


def crossed(pure: list[list[str]], size: int, toxic: list[list[str]], ordinary: list[list[str]], lengths: dict[str, int]) -> list[Crossed]:
    """One for each half; none where a half of pure has too little text for a dictionary."""
    out = []
    for half in (0, 1):
        content = dictionary(list(chain.from_iterable(pure[1 - half :: 2])), size)
        if not content:
            return []
        other = Ruler(content)
        out.append(Crossed(content, measured(toxic[half::2], lengths, other), measured(ordinary[half::2], lengths, other)))
    return out


def train(toxic: list[str], ordinary: list[str], prior: float) -> ToxicityModel:
    """toxic and ordinary: labelled texts; prior: the share of toxic ones among all labelled rows.

    Every second ordinary text is for the ordinary dictionary, the others are for calibration; a toxic text is in one
    half's dictionary and calibrates the other. The curve sees each text by the log odds of the other texts.
    """
    model = ToxicityModel(prior)
    of_t, of_o, cal_o = ([windows(x) for x in texts] for texts in (toxic, ordinary[::2], ordinary[1::2]))
    model.ordinary = dictionary(list(chain.from_iterable(of_o)), ORDINARY)
    if not model.ordinary or len(of_t) < 2 or len(cal_o) < 2:
        return model
    ruler = Ruler(model.ordinary)
    lengths = {w: ruler.length(w) for w in set(chain.from_iterable(chain(of_t, cal_o)))}
    pure, size, last = of_t, TOXIC, []
    for _ in range(ROUNDS + 1):
        found = crossed(pure, size, of_t, cal_o, lengths)
        if not found:
            break
        last, pure, size = found, [[] for _ in of_t], REFINED
        for half, x in enumerate(last):
            odds = x.odds().table()
            pure[half::2] = [[w for w, c in zip(ws, sizes) if odds[c][0] > PURE] for ws, sizes in zip(of_t[half::2], x.toxic)]
    if not last:
        return model
    model.toxic, model.odds = [x.content for x in last], [x.odds().table() for x in last]
    model.open()
    rows = [(odds.features_without(text, side), 1.0 - side) for x in last for odds in [x.odds()] for side, texts in enumerate((x.toxic, x.ordinary)) for text in texts]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    model.centre, model.spread = x.mean(0).tolist(), (x.std(0) + 1e-6).tolist()
    model.weights = logistic((x - model.centre) / model.spread, y, prior)
    return model


def logistic(x: np.ndarray, y: np.ndarray, prior: float) -> list[float]:
    """Weights and, last, the constant of a ridge logistic regression in which the classes weigh as in the prior; Newton steps."""
    z = np.c_[x, np.ones(len(x))]
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    ridge = np.diag([1.0] * x.shape[1] + [1e-3])
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        slope = z.T @ (weight * (p - y)) + ridge @ w
        curve = (z.T * (weight * p * (1 - p))) @ z + ridge
        w -= np.clip(np.linalg.solve(curve, slope), -2, 2)
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Train on at most sample rows of each class, those that come first by the hash of their key.

    Keys are chosen from the labels alone; 2 * sample of them are broadcast to find their texts, so no text is shuffled.
    A key with several labels is toxic if one of them says so; labels other than 0 and 1, null keys and null texts don't
    count. Where a key is in several documents, the first rows by hash are taken, so that never more than sample rows of
    a class come to the driver. Without enough text of both classes to train dictionaries on, every score is the prior.
    """
    known = labels.select(F.col(key).alias("id"), F.col(label).alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    known = known.groupBy("id").agg(F.max("label").cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    by_hash = F.xxhash64(F.lit(11), F.col("id"))
    first = [known.filter(F.col("label") == c).orderBy(by_hash, "id").limit(sample) for c in (0, 1)]
    rows = docs.select(F.col(key).alias("of"), F.col(text).alias("text")).filter("text is not null")
    chosen = rows.join(F.broadcast(first[0].unionByName(first[1])), F.col("of") == F.col("id")).select("label", by_hash.alias("h"), "id", F.xxhash64("text").alias("th"), "text")
    texts = [[r["text"] for r in chosen.filter(F.col("label") == c).orderBy("h", "id", "th").limit(sample).collect()] for c in (0, 1)]
    n = sum(sizes.values())
    return train(texts[1], texts[0], min(max(sizes.get(1, 0) / n if n else 0.1, 0.01), 0.99))


_models: dict[int, ToxicityModel] = {}


def scored(handle, token: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _models:
            _models.clear()
            _models[token] = handle.value
        score = _models[token].score
        for batch in batches:
            yield pa.record_batch({"id": batch.column(0), "score": pa.array([score(t.as_py()) for t in batch.column(1)], pa.float64())})

    return run


def toxicity_scores(docs: DataFrame, model: ToxicityModel, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key and score, 0 to 1.

    Null counts as empty; a text without words scores like one without toxic windows. Any key type, null and repeated keys
    included; repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    handle = spark.sparkContext.broadcast(model)  # three dictionaries and tables of lengths: under 500 KB
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(scored(handle, id(model) ^ random.getrandbits(60)), f"id {kind}, score double").select(F.col("id").alias(key), "score")


def clean(handle, token: int, column: str, most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _models:
            _models.clear()
            _models[token] = handle.value
        score = _models[token].score
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py() or "") < most for t in batch.column(column)], pa.bool_()))

    return run


def without_toxic(docs: DataFrame, model: ToxicityModel, *, text: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of docs that score under most, as they are, whatever their columns. No shuffle."""
    spark = docs.sparkSession
    ship(spark)
    handle = spark.sparkContext.broadcast(model)
    return docs.mapInArrow(clean(handle, id(model) ^ random.getrandbits(60), text, most), docs.schema)


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0

"""Hashed shingle sets and min-hash bands of texts, in numpy within tasks: what Spark's xxhash64() gives for the same values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Of XXH64, and the seed of Spark's xxhash64().
P1, P2, P3, P4, P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = 42
#: Hashes of a text that meet all permutations at once (so that they stay in the cache), and rows of an output batch.
PART, BATCH = 256, 512


def _left(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The last steps of XXH64, in place."""
    x ^= x >> np.uint64(33)
    x *= P2
    x ^= x >> np.uint64(29)
    x *= P3
    x ^= x >> np.uint64(32)
    return x


def of_ints(numbers: np.ndarray, seed: int = SEED) -> np.ndarray:
    """xxhash64() of ints that aren't negative."""
    x = np.uint64(seed) + P5 + np.uint64(4) ^ numbers.astype(np.uint64) * P1
    return _mixed(_left(x, 23) * P2 + P3)


def of_longs(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A row for each seed: the hash of each value under it, as xxhash64(a, b) hashes b under the hash of a."""
    x = (_left(values.view(np.uint64) * P2, 31) * P1)[None, :] ^ (seeds + P5 + np.uint64(8))[:, None]
    high = x >> np.uint64(37)
    x <<= np.uint64(27)
    x |= high
    x *= P1
    x += P4
    return _mixed(x)


def shingle_set(words: list[str], k: int) -> np.ndarray:
    """Sorted hashes (long) of the distinct runs of k words; of all words where there are fewer."""
    runs = map(" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else [" ".join(words)]
    runs = set(runs)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in runs), np.uint64, len(runs)).view(np.int64))


def signature(values: np.ndarray, perms: int) -> np.ndarray:
    """The least xxhash64(i, value) (as long) of each i below perms."""
    seeds = of_ints(np.arange(perms))
    parts = [of_longs(values[at : at + PART], seeds).view(np.int64).min(axis=1) for at in range(0, len(values), PART)]
    return np.min(parts, axis=0)


def band_keys(least: np.ndarray, bands: int) -> list[int]:
    """A hash for each band of a signature; texts that agree on a whole band share it."""
    x = of_ints(np.arange(bands))
    for column in least.reshape(bands, -1).T:
        x = _chained(column, x)
    return x.view(np.int64).tolist()


def _chained(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    x = _left(np.ascontiguousarray(values).view(np.uint64) * P2, 31) * P1 ^ seeds + P5 + np.uint64(8)
    return _mixed(_left(x, 27) * P1 + P4)


def sketches(k: int, bands: int, rows: int):
    """For mapInArrow over (id, text in normal form): id, form (128-bit hash of the text), s (shingle_set), keys (band_keys; none without bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                texts = batch.column(1).to_pylist()
                sets = [None if t is None else shingle_set(t.split(" "), k) for t in texts]
                keys = [None if s is None else band_keys(signature(s, bands * rows), bands) if bands else [] for s in sets]
                ends = np.concatenate([[0], np.cumsum([0 if s is None else len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate([s for s in sets if s is not None] or [np.empty(0, np.int64)])
                yield pa.record_batch({
                    "id": batch.column(0), "form": pa.array([None if t is None else xxhash.xxh3_128_digest(t) for t in texts], pa.binary()),
                    "s": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()), mask=pa.array([s is None for s in sets])),
                    "keys": pa.array(keys, pa.list_(pa.int64())),
                })

    return run

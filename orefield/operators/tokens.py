"""Terms of texts, numbered within blocks of documents: texts are cut in numpy and numbered by Arrow within tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKEN = r"[a-z0-9_.%-]+"
#: Bytes of UTF-8 that are part of a term.
INSIDE = np.array([i < 128 and bool(re.fullmatch(TOKEN, chr(i))) for i in range(256)])
#: Documents and bytes of text of a block.
ROWS, BYTES = 8192, 1 << 24


def terms(texts: pa.Array) -> tuple[np.ndarray, pa.LargeStringArray]:
    """How many terms each text (in lower case) has, a null one none; and all terms in order."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    ends = ends - ends[0]
    inside = INSIDE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]  # a term doesn't go on from one text to the next
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts = np.flatnonzero(first)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)]).astype(np.int64)
    return np.diff(np.searchsorted(starts, ends)), pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))


def dealt(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.Table]:
    """(doc_id, text) in tables of rows documents or size bytes of text at most, one document at least."""
    held, n, used = [], 0, 0
    for batch in batches:
        ends, at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)]), 0
        while at < batch.num_rows:
            to = max(min(at + rows - n, int(np.searchsorted(ends, ends[at] + size - used, "right")) - 1), at if held else at + 1)
            if to > at:
                held.append(batch.slice(at, to - at))
                n, used, at = n + to - at, used + int(ends[to] - ends[at]), to
            if at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, n, used = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def numbered(rows: int | None = None, size: int | None = None):
    """For mapInArrow over (doc_id, text in lower case): block with doc_id, len, codes, tfs of each document that has a term, and block with term, code, df of each term.

    A code is the number of a term in its block, and df counts documents of that block; a document's codes don't repeat.
    """
    rows, size = rows or ROWS, size or BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        of_task = TaskContext.get().partitionId() << 32
        for i, table in enumerate(dealt(batches, rows, size)):
            texts = table.column(1).combine_chunks()
            n, found = terms(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts)
            coded = found.dictionary_encode()
            names = coded.dictionary.cast(pa.string())
            key, tf = np.unique(np.repeat(np.arange(len(n)), n) * max(1, len(names)) + coded.indices.to_numpy(), return_counts=True)
            of, code = np.divmod(key, max(1, len(names)))
            some = np.flatnonzero(n)
            ends = pa.array(np.append(np.searchsorted(of, some), len(of)), pa.int32())
            ids = table.column(0).combine_chunks()
            whole = {
                "block": (pa.int64(), np.full(len(some), of_task + i), np.full(len(names), of_task + i)),
                "doc_id": (ids.type, ids.take(pa.array(some)), None), "len": (pa.int64(), n[some], None),
                "codes": (pa.list_(pa.int32()), pa.ListArray.from_arrays(ends, pa.array(code, pa.int32())), None),
                "tfs": (pa.list_(pa.int32()), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())), None),
                "term": (pa.string(), None, names), "code": (pa.int32(), None, np.arange(len(names))),
                "df": (pa.int64(), None, np.bincount(code, minlength=len(names))),
            }
            for at, m in ((1, len(some)), (2, len(names))):
                yield pa.record_batch({c: pa.nulls(m, x[0]) if x[at] is None else x[at] if isinstance(x[at], pa.Array) else pa.array(x[at], x[0]) for c, x in whole.items()})

    return run

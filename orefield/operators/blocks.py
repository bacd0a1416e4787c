"""Every row of a table against every row asked for, block against block, in numpy: what is exact and has no index stays as many
products as there are pairs, but no pair becomes a row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows and asked rows of a block, and cells of the matrix of the two that are held at once.
ROWS, ASKED, CELLS = 8192, 2048, 1 << 22


def met(rows: DataFrame, asked: DataFrame, by: Sequence[str], by_asked: Sequence[str], kernel: Callable, schema: str, block: int | None = None, block_asked: int | None = None) -> DataFrame:
    """What kernel(rows, asked) of Arrow tables gives for each block of rows with each block of asked; hashes of the columns by deal them out.

    A row is sent as often as there are blocks of asked, an asked one as often as there are blocks of rows.
    """
    rows, asked = written(rows, "rows"), written(asked, "asked")  # counted, then dealt
    n = [max(1, -(-df.count() // most)) for df, most in ((rows, block or ROWS), (asked, block_asked or ASKED))]
    own = lambda columns, of: F.pmod(F.xxhash64(F.lit(11), *columns), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    x = rows.withColumn("_i", own(by, n[0])).withColumn("_j", every(n[1]))
    y = asked.withColumn("_j", own(by_asked, n[1])).withColumn("_i", every(n[0]))
    return x.groupBy("_i", "_j").cogroup(y.groupBy("_i", "_j")).applyInArrow(kernel, schema)


def numbers(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """The columns side by side."""
    return np.array([table.column(c).to_numpy() for c in columns], np.float64).reshape(len(columns), table.num_rows).T


def label_sums(columns: Sequence[str], label: str, kind: pa.DataType):
    """Kernel: for each asked point and label the sum of its distances to the rows, which are points with a weight n."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows = rows.sort_by(label)
        points, places = numbers(rows, columns), numbers(asked, columns)
        names = rows.column(label).to_pylist()
        first = [i for i, x in enumerate(names) if not i or x != names[i - 1]]
        weight, sums = rows.column("n").to_numpy().astype(np.float64), []
        step = max(1, CELLS // max(1, len(points)))
        for at in range(0, len(places) if first else 0, step):
            square = sum((places[at : at + step, i, None] - points[None, :, i]) ** 2 for i in range(len(columns)))
            sums.append(np.add.reduceat(np.sqrt(square) * weight, first, axis=1))
        sums = np.concatenate(sums) if sums else np.empty((0, 1))
        out = {c: pa.array(np.repeat(places[: len(sums), i], len(first)), pa.float64()) for i, c in enumerate(columns)}
        return pa.table({**out, "other": pa.array([names[i] for i in first] * len(sums), kind), "d": pa.array(sums.ravel()[: len(first) * len(sums)], pa.float64())})

    return run


def _vectors(table: pa.Table, column: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Length of each vector, -1 where it is null or holds a null; and the vectors."""
    flat = table.column(column).combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    if not flat.null_count and not flat.flatten().null_count:
        ends = flat.offsets.to_numpy()
        values = flat.values.to_numpy(zero_copy_only=False).astype(np.float64)
        return np.diff(ends), np.split(values[ends[0] : ends[-1]], ends[1:-1] - ends[0]) if len(flat) else []
    lists = flat.to_pylist()
    whole = [x is not None and None not in x for x in lists]
    return np.array([len(x) if ok else -1 for x, ok in zip(lists, whole)], np.int64), [np.array(x if ok else [], np.float64) for x, ok in zip(lists, whole)]


def _cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.round(q @ v.T / (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))), 9)


def best(k: int, key: str, asked_key: str, ids: Sequence[pa.DataType], measure: str, other_only: bool = False):
    """Kernel: the k first rows of each asked one: by falling cosine rounded to 9 digits, or rising distance rounded to 8; then by key.

    Vectors of different length, or with a null, have no measure and come last. Distances are taken from squares and products, and
    again from differences for all that the error of that might put among the first k.
    """

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows = rows.sort_by(key)
        (sizes, v), (sizes_q, w) = _vectors(rows, "v"), _vectors(asked, "w")
        names, names_q = rows.column(key), asked.column(asked_key)
        own = {}
        if other_only:
            for i, x in enumerate(names.to_pylist()):
                own.setdefault(x, []).append(i)
        found_q, found, score = [], [], []
        step = max(1, CELLS // max(1, rows.num_rows))
        for size in np.unique(sizes_q).tolist() if rows.num_rows else []:
            here, at_q = np.flatnonzero(sizes == size) if size >= 0 else np.empty(0, np.int64), np.flatnonzero(sizes_q == size)
            matrix = np.array([v[i] for i in here], np.float64).reshape(len(here), max(size, 0))
            for start in range(0, len(at_q), step):
                part = at_q[start : start + step]
                q = np.array([w[i] for i in part], np.float64).reshape(len(part), max(size, 0))
                with np.errstate(divide="ignore", invalid="ignore"):
                    if measure == "cosine":
                        some = -_cosine(q, matrix)
                        error = np.zeros((len(part), 1))
                    else:
                        squares = (q * q).sum(axis=1)[:, None], (matrix * matrix).sum(axis=1)
                        some = squares[0] + squares[1] - 2 * (q @ matrix.T)
                        # of the products, and of rounding to 8 digits
                        error = 1e-12 * (squares[0] + (squares[1].max() if len(here) else 0)) + 4e-8 * np.sqrt(np.abs(some).max(axis=1, keepdims=True)) if len(here) else np.zeros((len(part), 1))
                error = np.where(np.isfinite(error), error, np.inf)
                order = np.full((len(part), rows.num_rows), np.inf)  # what has no measure is last
                order[:, here] = np.where(np.isnan(some), -np.inf if measure == "cosine" else 1e308, some)
                if other_only:
                    for i, x in enumerate(names_q.take(pa.array(part)).to_pylist()):
                        order[i, own.get(x, [])] = np.nan
                limit = np.sort(np.partition(order, min(k, rows.num_rows) - 1, axis=1)[:, : min(k, rows.num_rows)], axis=1)[:, -1:] if rows.num_rows > k else np.full((len(part), 1), np.inf)
                limit = np.where(np.isnan(limit), np.inf, limit)
                i, j = np.nonzero(order <= limit + error)
                value = np.full(len(i), np.nan)
                is_here = np.zeros(rows.num_rows, bool)
                is_here[here] = True
                measured, place = is_here[j], np.searchsorted(here, j)
                if measure == "cosine":
                    value[measured] = -some[i[measured], place[measured]]
                    rank = np.where(measured, np.where(np.isnan(value), -np.inf, -value), np.inf)
                else:
                    for a in range(0, len(i), 1 << 16):
                        z = slice(a, a + (1 << 16))
                        m = np.flatnonzero(measured[z]) + a
                        value[m] = np.round(np.sqrt(((matrix[place[m]] - q[i[m]]) ** 2).sum(axis=1)), 8)
                    rank = np.where(measured & ~np.isnan(value), value, np.where(measured, 1e308, np.inf))
                sort = np.lexsort((j, rank, i))
                i, j, value, measured = i[sort], j[sort], value[sort], measured[sort]
                starts = np.searchsorted(i, np.arange(len(part)))
                first = np.arange(len(i)) - starts[i] < k
                found_q.append(part[i[first]])
                found.append(j[first])
                score.append(pa.array(value[first], pa.float64(), mask=~measured[first]))
        at_q, at = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_q, found))
        columns = [names_q.take(pa.array(at_q)).cast(ids[0]), names.take(pa.array(at)).cast(ids[1]), pa.concat_arrays(score) if score else pa.array([], pa.float64())]
        return pa.table(columns, names=[asked_key, key, "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int, measure: str = "cosine", other_only: bool = False) -> DataFrame:
    """query_id, doc_id, score: among others the k nearest rows (doc_id, v) of each query (query_id, w), by cosine or distance; the k first of each block.

    other_only: a row isn't compared with the query of its own id.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = queries.schema["query_id"].dataType, rows.schema["doc_id"].dataType
    schema = f"query_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, score double"
    return met(rows, queries, ["doc_id"], ["query_id"], best(k, "doc_id", "query_id", [to_arrow_type(x) for x in kinds], measure, other_only), schema)


def _lists(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The row of each element of a list column without nulls, and the elements."""
    flat = table.column(column).combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    ends = flat.offsets.to_numpy()
    return np.repeat(np.arange(len(flat)), np.diff(ends)), flat.values.to_numpy()[ends[0] : ends[-1]]


def _first(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k of each query with the highest score, then the first rows."""
    order = np.lexsort((row, -score, query))
    query, row, score = query[order], row[order], score[order]
    new = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.empty(0, np.int64)
    place = np.arange(len(query)) - np.repeat(new, np.diff(np.append(new, len(query))))
    return query[place < k], row[place < k], score[place < k]


def matching(k: int, ids: Sequence[pa.DataType], saturation: float | None):
    """Kernel: the k first documents (doc_id, codes, tfs, norm) of each query (query_id, code, weight: a row for each term) among those that share a term.

    Codes are those of the documents' block. A shared term counts its weight, times tf (saturation + 1) / (tf + norm) if there is
    a saturation. Documents come by falling score rounded to 9 digits, then by id.
    """

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        query = pa.concat_arrays([x.cast(ids[0]) for x in asked.column("query_id").chunks] or [pa.array([], ids[0])]).dictionary_encode("encode")
        names, of_q = query.dictionary, query.indices.to_numpy()
        terms, at = np.unique(asked.column("code").to_numpy(), return_inverse=True)
        weights = np.zeros((len(names), len(terms)))
        weights[of_q, at] = asked.column("weight").to_numpy()
        of, code = _lists(rows, "codes")
        place = np.full(1 + max(code.max(initial=0), terms.max(initial=0)), -1)
        place[terms] = np.arange(len(terms))
        place = place[code]
        ours = np.flatnonzero(place >= 0)
        of, place, value = of[ours], place[ours], np.ones(len(ours))
        if saturation is not None:
            tf = _lists(rows, "tfs")[1][ours]
            value = tf * (saturation + 1) / (tf + rows.column("norm").to_numpy()[of])
        positive = bool((weights[of_q, at] > 0).all())
        there = None if positive else _filled(weights.shape, of_q, at, 1, np.float32)
        found = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        step = max(1, CELLS // max(1, len(terms), len(names)))
        for start in range(0, rows.num_rows if len(terms) else 0, step):
            a, b = np.searchsorted(of, [start, start + step])
            cells = _filled((min(step, rows.num_rows - start), len(terms)), of[a:b] - start, place[a:b], value[a:b])
            score = weights @ cells.T
            hit = score > 0 if positive else there @ (cells > 0).astype(np.float32).T > 0
            score = np.where(hit, np.round(score, 9), -np.inf)
            least = np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] > k else -np.inf
            q, d = np.nonzero((score >= least) & (score > -np.inf))
            new = q, d + start, score[q, d]
            found = _first(*[np.concatenate(x) for x in zip(found, new)], k)
        query, row, score = found
        columns = [names.take(pa.array(query)), rows.column("doc_id").take(pa.array(row)).cast(ids[1]), pa.array(score, pa.float64())]
        return pa.table(columns, names=["query_id", "doc_id", "score"])

    return run


def _filled(shape: tuple[int, int], i: np.ndarray, j: np.ndarray, value: np.ndarray | float, kind: type = np.float64) -> np.ndarray:
    out = np.zeros(shape, kind)
    out[i, j] = value
    return out


def best_matches(docs: DataFrame, terms: DataFrame, asked: DataFrame, k: int, saturation: float | None = None) -> DataFrame:
    """query_id, doc_id, score: among others the k best documents of each query by matching().

    docs: block, doc_id, codes and what else matching() takes; terms: block, code, term; asked: query_id, term (distinct for a query),
    weight. A block meets the queries in its own codes, so terms are only compared where a block's different ones meet those asked for.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = asked.schema["query_id"].dataType, docs.schema["doc_id"].dataType
    schema = f"query_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, score double"
    n = max(1, -(-asked.select("query_id").distinct().count() // min(ASKED, 256)))
    x = docs.withColumnRenamed("block", "_i").withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    y = terms.join(asked, "term").select(F.col("block").alias("_i"), "query_id", "code", "weight", F.pmod(F.xxhash64(F.lit(11), "query_id"), F.lit(n)).cast("int").alias("_j"))
    return x.groupBy("_i", "_j").cogroup(y.groupBy("_i", "_j")).applyInArrow(matching(k, [to_arrow_type(x) for x in kinds], saturation), schema)

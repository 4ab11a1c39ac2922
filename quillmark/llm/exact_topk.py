"""Exact top-k inner-product search with vector-approximation files.

Vectors become integers, floor(256 x).  Tasks write blocks of them into the
shared folder: exact values, and cells of one byte per component.  A search task
scans the cells of its vectors for each block of queries.  A cell gives a lower
and an upper bound of every component, so each vector has bounds of its score;
exact vectors are gathered from the mapped file in the order of their upper bounds,
and reading stops when the k-th best exact score is above the next bound; what a
block's bounds need besides its cells (shift, largest component) stands in a file
of its own.  Tasks return k rows a query, of which the best k of all tasks are the
result.  The driver lists the query blocks, a row for 256 queries, and each task
goes through all of them: the number of queries bounds both.

Defined results: vectors that are null, or hold null or non-finite components,
and rows without an id take no part; a query is compared with vectors of its own
length only; rows with the query's id are not its candidates, and repeated rows
of a query give one result; columns other than id and vector are ignored, whatever
their names; vectors of components too large for cells are compared one by one; ties go to the smaller id; scores beyond 64 bits stop
at their limits; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .shared import released, settle, shared_dir

#: Vectors in a block, and queries that are compared with it at once.
BLOCK, QUERIES = 8192, 256
#: Bits of a cell.
CELL_BITS = 6
#: Exact vectors read at once while bounds are followed.
STEP = 32
_BIG = 1 << 53


def integers(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: rows that hold finite components only, and their integers."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    off = np.frombuffer(vectors.buffers()[1], np.int32, len(vectors) + 1, vectors.offset * 4).astype(np.int64) if len(vectors) else np.zeros(1, np.int64)
    x = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.append(0, np.cumsum(~np.isfinite(x)))
    good = (bad[off[1:]] == bad[off[:-1]]) & np.asarray(vectors.is_valid())
    size = off[1:] - off[:-1]
    out = {}
    for n in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == n))
        v = np.floor(256 * x[off[rows][:, None] + np.arange(n)])
        out[n] = rows, v.astype(np.int64) if not v.size or np.abs(v).max() < 1 << 62 else np.array([[int(c) for c in r] for r in v], object)
    return out


def largest(v: np.ndarray) -> int:
    return int(np.abs(v).max()) if v.size else 0


def shift_of(v: np.ndarray) -> int:
    """Low bits that a cell leaves out, so that all cells fit."""
    top = largest(v)
    return max(0, top.bit_length() - CELL_BITS + 1)


def _write(vectors: DataFrame, path: str, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors; returns block, n (vector length) and plain (whether it has cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(n: int) -> pa.RecordBatch:
            ids, v = (np.concatenate(x) for x in zip(*held.pop(n)))
            place = f"{path}/{uuid.uuid4().hex}"
            if v.dtype == object:
                v = np.array([[str(c) for c in r] for r in v])
                store.save(place, id=ids, exact=v)
            else:
                s = shift_of(v)
                store.save(place, id=ids, exact=v, cell=(v >> s).astype(np.int8), head=np.array([s, largest(v)]))
            return pa.RecordBatch.from_arrays([pa.array([place]), pa.array([n], pa.int32()), pa.array([v.dtype.kind == "i"])], ["block", "n", "plain"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for n, (rows, v) in integers(batch.column(1)).items():
                for at in range(0, len(rows), size):
                    held.setdefault(n, []).append((ids[rows[at : at + size]], v[at : at + size]))
                    if sum(len(x[0]) for x in held[n]) >= size:
                        yield flush(n)
        for n in list(held):
            yield flush(n)

    return vectors.filter(F.col("id").isNotNull()).select("id", "vector").mapInArrow(released(run), "block string, n int, plain boolean")


def _exact(place: str) -> np.ndarray:
    v = store.load(place, "exact")
    return v if v.dtype != "U" and v.dtype.kind != "U" else np.array([[int(c) for c in r] for r in v], object)


def search_block(q: np.ndarray, q_ids: np.ndarray, place: str, plain: bool, best: list[list[tuple[int, int]]], k: int) -> int:
    """Merges the block's vectors into ``best``: for each query its (-score, id), ascending; returns how many exact vectors were read.

    A ``plain`` block has cells.
    """
    ids = store.load(place, "id")
    shift, top = store.load(place, "head").tolist() if plain else (0, _BIG)
    if not plain or q.dtype == object or max(top, largest(q)) ** 2 * max(1, q.shape[1]) >= _BIG:
        v = _exact(place)
        for i in range(len(q)):
            scores = [(-min(max(sum(int(a) * int(b) for a, b in zip(q[i], x)), -(1 << 63)), (1 << 63) - 1), int(d)) for d, x in zip(ids, v) if d != q_ids[i]]
            best[i] = sorted(best[i] + scores)[:k]
        return len(v) * len(q)
    width, read = (1 << shift) - 1, 0
    scale = float(width + 1)
    middle = (np.asarray(store.load(place, "cell"), np.float64) * scale) @ q.T.astype(np.float64)
    up = middle + width * np.maximum(q, 0).sum(1)
    down = middle + width * np.minimum(q, 0).sum(1)
    exact = store.load(place, "exact")
    for i in range(len(q)):
        upper, other = up[:, i], ids != q_ids[i]
        sure = down[other, i]
        floor = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else -np.inf
        known = best[i]
        if len(known) == k:
            floor = max(floor, -known[-1][0])
        near = np.flatnonzero((upper >= floor) & other)
        near = near[np.argsort(-upper[near], kind="stable")]
        for at in range(0, len(near), STEP):
            own = near[at : at + STEP]
            if len(known) == k and upper[own[0]] < -known[-1][0]:
                break
            read += len(own)
            known = sorted(known + list(zip((-(exact[own].astype(np.float64) @ q[i])).astype(np.int64).tolist(), ids[own].tolist())))[:k]
        best[i] = known
    return read


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (``is_query`` over column id) its k best vectors."""
    path = f"{shared_dir(vectors.sparkSession)}/va-file-{uuid.uuid4().hex}"
    queries = vectors.filter(is_query).dropDuplicates(["id"])
    asked = settle(_write(queries.repartition(max(1, -(-queries.count() // QUERIES)), "id"), path, QUERIES)).collect()
    blocks = settle(_write(vectors, path, BLOCK))
    tasks = max(1, min(blocks.count(), 4 * vectors.sparkSession.sparkContext.defaultParallelism))
    asked_blocks = [(r["block"], r["n"]) for r in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3)))]
        own.sort()
        for block, n in asked_blocks:
            q, q_ids = _exact(block), np.asarray(store.load(block, "id"))
            q = q if q.dtype == object else np.asarray(q)
            best: list[list[tuple[int, int]]] = [[] for _ in q_ids]
            for place, m, plain in own:
                if m == n:
                    search_block(q, q_ids, place, plain, best, k)
            rows = [(int(i), d, -s) for i, found in zip(q_ids, best) for s, d in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["query_id", "vec_id", "score"])

    found = blocks.repartition(tasks, "block").mapInArrow(released(run), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

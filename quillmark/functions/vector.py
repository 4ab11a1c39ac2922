"""Vector kernels, exact and approximate search, hybrid scores, local embeddings."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.sources.shared import shared_dir


def literal(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def _checked(a: Column, b: Column, value: Column) -> Column:
    """The value; vectors of different lengths are an error."""
    return F.when(F.size(a) == F.size(b), value).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors differ in length")).cast("double"))


def _sum(a: Column, b: Column, f) -> Column:  # noqa: ANN001
    each = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), f)
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _checked(a, b, _sum(a, b, lambda x, y: x * y))


def l2(a: Column, b: Column) -> Column:
    return _checked(a, b, F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y))))


def l2_score(a: Column, b: Column) -> Column:
    return 1 / (1 + l2(a, b))


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(_sum(a, a, lambda x, y: x * y)) * F.sqrt(_sum(b, b, lambda x, y: x * y))
    return _checked(a, b, F.when(norms == 0, 0.0).otherwise(_sum(a, b, lambda x, y: x * y) / norms))


def distance(a: Column, b: Column, metric: str) -> Column:
    """``l2`` (<->), ``cosine`` (<=>) or ``dot`` (<#>, the negative product)."""
    return {"l2": lambda: l2(a, b), "cosine": lambda: 1 - cosine(a, b), "dot": lambda: -dot(a, b)}[metric]()


def top_k(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int, metric: str = "l2") -> DataFrame:
    """The k nearest rows by an exact scan; a partial top-k in each task, one merge."""
    d = distance(F.col(vector), literal(query), metric)
    return df.select(key, d.alias("distance")).orderBy("distance", key).limit(k)


def hybrid(search: Column, vector: Column) -> Column:
    return F.round(0.65 * search + 0.35 * vector, 12)


class IVF:
    """Inverted lists: rows are assigned to the nearest of ``lists`` centroids; a query probes some lists.

    Centroids are fitted on a sample of at most ``sample`` rows; every row is listed.
    Lists are stored once, a folder each, so a search reads the probed lists only.
    """

    def __init__(self, df: DataFrame, key: str, vector: str, lists: int = 64, sample: int = 2560, seed: int = 1) -> None:
        self.key, self.vector = key, vector
        bounded = df.select(vector).filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.col(key), F.lit(seed))).limit(sample)
        x = np.array([r[0] for r in bounded.collect()], float)
        rng = np.random.default_rng(seed)
        c = x[rng.permutation(len(x))[: min(lists, len(x))]]
        for _ in range(10):
            own = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
        self.centroids = c

        @F.pandas_udf("int")
        def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                v = np.array(s.tolist(), float).reshape(len(s), -1)
                yield pd.Series(((v**2).sum(1)[:, None] - 2 * v @ c.T + (c**2).sum(1)).argmin(1))

        path = f"{shared_dir(df.sparkSession)}/ivf-{uuid.uuid4().hex}"
        rows = df.filter(F.col(vector).isNotNull()).withColumn("list_id", nearest(vector))
        rows.write.partitionBy("list_id").parquet(path)
        self.listed = df.sparkSession.read.schema(rows.schema).parquet(path)

    def search(self, query: Sequence[float], k: int, probes: int = 1, metric: str = "l2") -> DataFrame:
        """The k nearest of the probed lists, ranked by exact distance."""
        order = ((self.centroids - np.array(query, float)) ** 2).sum(1).argsort()[:probes].tolist()
        return top_k(self.listed.filter(F.col("list_id").isin(*order)), self.key, self.vector, query, k, metric)


class Hyperplanes:
    """Approximate search by signs of random projections: rows that share a bucket with the query
    in one of ``tables`` tables are ranked by exact distance.

    Bucket numbers are columns, so an index is one more table, and a search is a
    filter on them that the scan can use.
    """

    def __init__(self, df: DataFrame, key: str, vector: str, dimensions: int, tables: int = 12, bits: int = 6, seed: int = 1) -> None:
        self.key, self.vector = key, vector
        self.planes = np.random.default_rng(seed).normal(size=(tables, bits, dimensions))
        planes = self.planes

        @F.pandas_udf("array<int>")
        def buckets(s: pd.Series) -> pd.Series:
            v = np.array(s.tolist(), float).reshape(len(s), -1)
            return pd.Series(list(_signs(v, planes)))

        self.index = df.filter(F.col(vector).isNotNull()).withColumn("buckets", buckets(vector))

    def search(self, query: Sequence[float], k: int, metric: str = "cosine") -> DataFrame:
        own = _signs(np.array([query], float), self.planes)[0]
        near = self.index.filter(F.exists(F.zip_with("buckets", F.array(*(F.lit(int(b)) for b in own)), lambda a, b: a == b), lambda x: x))
        return top_k(near, self.key, self.vector, query, k, metric)


def _signs(v: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Bucket numbers by row and table."""
    up = np.einsum("nd,tbd->ntb", v, planes) > 0
    return (up << np.arange(planes.shape[1])).sum(2).astype(np.int32)


def embed(text: Column, dimensions: int = 64, model: str = "local", salt: str = "document") -> Column:
    """A deterministic unit vector from SHA-256 digests of the text."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else embed_one(x, dimensions, model, salt))

    return run(text)


def embed_one(text: str, dimensions: int = 64, model: str = "local", salt: str = "document") -> list[float]:
    raw = b""
    prefix = b"\0".join((model.encode(), salt.encode(), text.encode()))
    for i in range(-(-dimensions // 8)):
        raw += hashlib.sha256(prefix + i.to_bytes(8, "big")).digest()
    bits = np.frombuffer(raw, ">u4")[:dimensions].astype(np.uint32)
    v = ((bits >> 9) | np.uint32(0x3F800000)).view(np.float32)
    v = (v - np.float32(1)) * np.float32(2) - np.float32(1)
    size = np.sqrt(np.float32((v * v).sum()))
    return (v / size).tolist() if size > np.finfo(np.float32).eps else [1.0] + [0.0] * (dimensions - 1)

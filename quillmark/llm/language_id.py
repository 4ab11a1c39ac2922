"""Language identification by the nearest centroid of TF-IDF n-gram vectors.

A text's vector holds the byte trigrams of its runs of letters (ASCII letters and
all bytes of other characters), each run between two spaces and in lower case as
far as Latin-1 goes, hashed into ``DIMS`` places, with damped counts
times inverse document frequencies, at length 1.  Document frequencies cover all
labelled training texts.  Each language has up to ``CENTROIDS`` centroids, found
by spherical k-means on a sample of at most ``SAMPLE`` of its training texts;
that bound is the parameter ``sample``.  A text gets the language of the centroid
with the highest cosine; one that is farther from it than nearly all of the
language's own sample is marked ``rejected``.

Defined results: texts that are null or without a letter are ``und`` with score
0; an empty training set makes every text ``und``; repeated rows count and are
predicted again; columns besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as tc

DIMS = 4096
CENTROIDS = 4
SAMPLE = 600
#: Part of a language's sample that lies within its distance of rejection.
WITHIN = 0.999
ROUNDS = 12
#: Rows whose dense vectors are held at once.
ROWS = 512
#: White space, digits and ASCII punctuation part the runs.
_FOLDED = np.where(np.arange(256) < 0x80, np.uint8(0x20), np.arange(256).astype(np.uint8))
_FOLDED[97:123] = np.arange(97, 123)
_FOLDED[65:91] = np.arange(97, 123)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def held_out(doc_id: object) -> bool:
    """Whether crc32 of the id as text, modulo 4, is 2: such documents are not learnt from."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def in_training() -> Column:
    n = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")).cast("binary"))
    return (n % 4 != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull()


def counts(text: pa.Array) -> np.ndarray:
    """Trigram counts, a row of ``DIMS`` for each text."""
    body, off = tc.raw(text)
    rows = len(off) - 1
    if len(body) < 1:
        return np.zeros((rows, DIMS), np.float32)
    b = _FOLDED[body]
    upper = np.flatnonzero((b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[:-1] == 0xC3) & (b[1:] != 0x97)) + 1
    b[upper] += 0x20
    b = b.astype(np.uint32)
    left, right = np.empty_like(b), np.empty_like(b)
    left[1:], right[:-1] = b[:-1], b[1:]
    left[0] = right[-1] = 0x20
    some = off[:-1][off[:-1] < off[1:]]
    left[some] = 0x20
    right[off[1:][off[:-1] < off[1:]] - 1] = 0x20
    at = np.flatnonzero(b != 0x20)
    gram = ((left[at] << np.uint32(16)) | (b[at] << np.uint32(8)) | right[at]) * np.uint32(2654435761)
    row = np.searchsorted(off, at, "right") - 1
    place = row * DIMS + (gram >> np.uint32(32 - DIMS.bit_length() + 1))
    return np.bincount(place, minlength=rows * DIMS).reshape(rows, DIMS).astype(np.float32)


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(c) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for lo, hi in tc.slices(batch.column("text")):
        for at in range(lo, hi, ROWS):
            yield batch.slice(at, min(ROWS, hi - at))


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    labels: tuple[str, ...]
    centroids: np.ndarray
    least: np.ndarray


def frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each place is used, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for part in _parts(batch):
                df += (counts(part.column("text")) > 0).sum(0)
                n += part.num_rows
        places = np.append(np.flatnonzero(df), DIMS)
        yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), pa.array(np.append(df, n)[places])], ["place", "n"])

    df = np.zeros(DIMS + 1, np.int64)
    for r in train.select("text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        df[r["place"]] = r["n"]
    return df[:DIMS], int(df[DIMS])


def cluster(v: np.ndarray, k: int) -> np.ndarray:
    """Centroids by spherical k-means, begun with the texts farthest from each other."""
    chosen = [v.mean(0)]
    for _ in range(1, min(k, len(v))):
        chosen.append(v[np.argmin(np.max(v @ np.stack(chosen).T, axis=1))])
    c = np.stack(chosen)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    for _ in range(ROUNDS):
        own = np.argmax(v @ c.T, axis=1)
        for i in range(len(c)):
            if (own == i).any():
                m = v[own == i].mean(0)
                c[i] = m / max(float(np.linalg.norm(m)), 1e-9)
    return c


def train(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learns from labelled rows (text, lang); pass the training rows only."""
    df, n = frequencies(docs)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    share = {r["lang"]: min(1.0, sample / r["n"]) for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").to_pylist()
            rank = batch.column("rank").to_numpy()
            chosen = batch.filter(pa.array([r < share[x] for r, x in zip(rank.tolist(), lang)], pa.bool_()))
            for part in _parts(chosen):
                v = vectors(counts(part.column("text")), idf)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("rank"), pa.array([x.astype("<f4").tobytes() for x in v], pa.binary())], ["lang", "rank", "v"])

    def fit(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table, [("rank", "ascending"), ("v", "ascending")])).slice(0, sample)
        v = np.frombuffer(b"".join(table["v"].to_pylist()), "<f4").reshape(-1, DIMS)
        c = cluster(v, centroids)
        least = float(np.quantile((v @ c.T).max(1), 1 - WITHIN))
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(c)), "c": pa.array([x.astype("<f4").tobytes() for x in c], pa.binary()), "least": pa.array([least] * len(c))})

    rank = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1) / F.lit(float(1 << 63))
    found = docs.select("lang", "text", rank.alias("rank")).mapInArrow(pick, "lang string, rank double, v binary").groupBy("lang").applyInArrow(fit, "lang string, c binary, least double").collect()
    found.sort(key=lambda r: (r["lang"], r["c"]))
    return Model(idf, tuple(r["lang"] for r in found), np.frombuffer(b"".join(bytes(r["c"]) for r in found), "<f4").reshape(-1, DIMS), np.array([r["least"] for r in found]))


def has_letter(text: pa.Array) -> np.ndarray:
    body, off = tc.raw(text)
    sums = np.append(0, np.cumsum(_LETTER[body]))
    found = sums[off[1:]] > sums[off[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(map(str.isalpha, text[i].as_py() or ""))
    return found


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.labels, "und"], object)
        for batch in batches:
            for part in _parts(batch):
                text, ids = part.column("text"), part.column("doc_id")
                letters = has_letter(text)
                if len(model.labels):
                    near = vectors(counts(text), model.idf) @ model.centroids.T
                    best = near.argmax(1)
                    score = np.clip(near[np.arange(len(near)), best], 0, 1).astype(float)
                    far = score < model.least[best]
                else:
                    letters[:] = False
                    best, score, far = np.zeros(len(text), int), np.zeros(len(text)), np.zeros(len(text), bool)
                best = np.where(letters, best, len(names) - 1)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([held_out(x) for x in ids.to_pylist()], pa.bool_()), pa.array(names[best].tolist(), pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(far | ~letters)],
                    ["doc_id", "held_out", "lang_pred", "score", "rejected"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def learn_and_predict(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs.filter(in_training())))

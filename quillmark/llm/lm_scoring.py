"""Interpolated modified Kneser-Ney scoring with a model counted in Spark.

Three passes over the texts.  The first counts tokens, the second counts pairs
of adjacent tokens, both as blocks of sorted 64-bit hashes with counts that are
merged shard by shard (beyond 4,096 shards in two steps, so that blocks stay few);
a shard writes its part of the model as sorted hash
arrays into the shared folder.  The third pass memory-maps those arrays in every
worker and scores whole texts.  Pairs are sharded by their first token, pairs of
very frequent first tokens by the whole pair, so no shard holds all the pairs of
a hot token.

The model, for a token w after v:

    P(w | v) = (c(vw) - D(c(vw))) / c(v.) + (D1 n1(v) + D2 n2(v) + D3 n3(v)) / c(v.) * P(w)
    P(w)     = (k(w) - E(k(w))) / K + (E1 m1 + E2 m2 + E3 m3) / K / (V + 1)

c counts pairs, k(w) is the number of distinct tokens before w, K their sum; D
and E are the discounts of Chen and Goodman for counts of 1, 2 and more.  An
unseen v leaves P(w); an unseen w has only the uniform share.

Defined results: a null or empty text holds the end token only; repeated rows
count and are scored again; an empty training set gives a uniform model with
V = 0; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from . import textcore as tc
from .shared import parts, released, settle, shared_dir

#: A task sends what it has counted after so many tokens.
FLUSH = 1_500_000
#: Tokens whose slices are looked up together, so that a task visits each shard few times.
ROUND = 3_000_000
#: Input bytes for each shard of the model.
SHARD_BYTES = 6 << 20
#: Shards that a task splits its counts into at once; where there are more, groups of shards are split once more.
WIDE = 4096
#: Tokens at most whose pairs are sharded by the whole pair; the model carries their statistics.
MOST_HOT = 1 << 16
#: What stands before a document's first token.
BEGIN = int(tc.mix(np.array([0xBE61], np.uint64))[0])


def held_out(doc_id: object) -> bool:
    """Whether a document is kept out of training: crc32 of its id as text, modulo 10, is 0."""
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of a batch's tokens: its words, then one end, of each row."""
    h, row, _, _, n = tc.words(text, lower=True)
    at = np.cumsum(n)
    return np.insert(h, at, np.uint64(tc.END)), np.insert(row, at, np.arange(len(n)))


def before(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The token before each token of a batch."""
    v = np.empty_like(h)
    v[1:] = h[:-1]
    v[np.append(True, row[1:] != row[:-1])] = BEGIN
    return v


@dataclass(frozen=True)
class Model:
    """What workers need besides the arrays under ``path``; ``there`` tells by kind which shards have arrays."""

    path: str
    shards: int
    hot: tuple[int, ...]
    hot_stats: tuple[tuple[int, int, int, int], ...]
    n: int
    v: int
    docs: int
    k: int
    there: dict[str, np.ndarray]
    pair_discounts: tuple[float, float, float]
    token_discounts: tuple[float, float, float]
    token_counts: tuple[int, int, int]

    def pair_shard(self, v: np.ndarray, pair: np.ndarray) -> np.ndarray:
        return shard_of(np.where(np.isin(v, np.array(self.hot, np.uint64)), pair, v), self.shards)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; where counts of counts are too few, fixed ones."""
    if not (n1 and n2):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    one, two = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    three = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return tuple(min(max(d, 0.05), top) for d, top in ((one, 1.0), (two, 2.0), (three, 3.0)))


def _rows(v: np.ndarray | None, w: np.ndarray, c: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row of arrays for each place."""
    order = np.argsort(place, kind="stable")
    found, start = np.unique(place[order], return_index=True)
    bounds = np.append(start, len(order))
    rows = []
    for k, lo, hi in zip(found.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        own = order[lo:hi]
        rows.append((k, v[own].tobytes() if v is not None else b"", w[own].tobytes(), c[own].astype(np.uint32).tobytes()))
    if rows:
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])], ["shard", "v", "w", "c"])


def _width(shards: int) -> int:
    """Shards in a group that is split once more."""
    return -(-shards // WIDE)


def _blocks(held: list[np.ndarray], shards: int, hot: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Counts of what a task holds, one row for each shard or group of shards."""
    if hot is None:
        (w,) = held
        w, c = summed(w, np.ones(len(w), np.int64))
        v, s = np.zeros(0, np.uint64), shard_of(w, shards)
    else:
        v, w = held
        near = (v & np.uint64(0xFFFFFFFF00000000)) | (w >> np.uint64(32))
        order = np.argsort(near)
        v, w = v[order], w[order]
        first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
        c = np.diff(np.append(first, len(v)))
        v, w = v[first], w[first]
        s = shard_of(np.where(np.isin(v, hot), tc.combine(v, w), v), shards)
    yield from _rows(v if hot is not None else None, w, c, s.astype(np.int64) // _width(shards))


def _fine(blocks: DataFrame, shards: int, hot: tuple[int, ...] | None) -> DataFrame:
    """Blocks of groups of shards, split into those of shards."""
    width = _width(shards)
    if width == 1:
        return blocks
    pairs = hot is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.array(hot, np.uint64) if pairs else None
        held: list[list[np.ndarray]] = [[], [], []]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            v, w, c = (np.concatenate(x) if x else None for x in held)
            yield from _rows(v, w, c, shard_of(np.where(np.isin(v, frequent), tc.combine(v, w), v) if pairs else w, shards).astype(np.int64))

        for batch in batches:
            for v, w, c in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                for at, (part, kind) in enumerate(((v, np.uint64), (w, np.uint64), (c, np.uint32))):
                    if at or pairs:
                        held[at].append(np.frombuffer(part, kind))
                size += len(w) // 8
                if size >= FLUSH:
                    yield from flush()
                    held, size = [[], [], []], 0
        if size:
            yield from flush()

    return blocks.select("shard", "v", "w", "c").repartition(-(-shards // width), "shard").mapInArrow(released(run), "shard int, v binary, w binary, c binary")


def _count(train: DataFrame, shards: int, hot: tuple[int, ...] | None) -> DataFrame:
    """Blocks of token counts, or of pair counts where ``hot`` is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = None if hot is None else np.array(hot, np.uint64)
        held: list[list[np.ndarray]] = [[], []]
        size = 0
        for batch in batches:
            text = batch.column(0)
            for lo, hi in tc.slices(text):
                h, row = tokens(text.slice(lo, hi - lo))
                held[1].append(h)
                if hot is not None:
                    held[0].append(before(h, row))
                size += len(h)
                if size >= FLUSH:
                    yield from _blocks([np.concatenate(x) for x in held if x], shards, frequent)
                    held, size = [[], []], 0
        if size:
            yield from _blocks([np.concatenate(x) for x in held if x], shards, frequent)

    return _fine(train.select("text").mapInArrow(released(run), "shard int, v binary, w binary, c binary"), shards, hot)


def _column(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """The values of all blocks, one after another, without a copy."""
    blocks = table[name].combine_chunks()
    blocks = blocks.chunk(0) if isinstance(blocks, pa.ChunkedArray) else blocks
    off = tc.byte_offsets(blocks)
    data = blocks.buffers()[2]
    return np.zeros(0, kind) if data is None else np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(kind)


def _by_shard(blocks: DataFrame, shards: int, merge: Callable[[int, pa.Table], dict], schema: str) -> DataFrame:
    """One call of ``merge`` for each shard; its result's keys are columns of one row or more."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table(merge(table["shard"][0].as_py(), table))

    return blocks.repartition(shards, "shard").groupBy("shard").applyInArrow(run, schema)


def train(docs: DataFrame) -> Model:
    """Counts the documents' texts and writes the model's arrays; returns their description."""
    shards = parts(docs, SHARD_BYTES)
    path = f"{shared_dir(docs.sparkSession)}/kneser-ney-{uuid.uuid4().hex}"

    def merge_tokens(shard: int, table: pa.Table) -> dict:
        w, c = summed(_column(table, "w", np.uint64), _column(table, "c", np.uint32).astype(np.int64))
        store.save(f"{path}/token-{shard:05d}", hash=w, count=c)
        top = np.argsort(-c, kind="stable")[:64]
        end = np.flatnonzero(w == np.uint64(tc.END))
        return {"shard": pa.array([shard], pa.int32()), "n": [int(c.sum())], "v": [len(w)], "docs": [int(c[end].sum())], "top": pa.array([w[top].view(np.int64).tolist()], pa.list_(pa.int64())), "most": pa.array([c[top].tolist()], pa.list_(pa.int64()))}

    rows = settle(_by_shard(_count(docs, shards, None), shards, merge_tokens, "shard int, n long, v long, docs long, top array<long>, most array<long>"))
    n, v, n_docs = (x or 0 for x in rows.agg(F.sum("n"), F.sum("v"), F.sum("docs")).first())
    tops = rows.select(F.explode(F.arrays_zip("top", "most")).alias("t")).select("t.top", "t.most").filter(F.col("most") * (4 * shards) > n)
    hot = tuple(sorted({BEGIN, *(r["top"] & (1 << 64) - 1 for r in tops.orderBy(F.desc("most"), "top").limit(MOST_HOT).collect())}))
    there = {"token": _listed(rows, shards)}

    def merge_pairs(shard: int, table: pa.Table) -> dict:
        first, second = _column(table, "v", np.uint64), _column(table, "w", np.uint64)
        c = _column(table, "c", np.uint32)
        pair = tc.combine(first, second)
        order = np.argsort(pair)
        pair = pair[order]
        start = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        c = np.add.reduceat(c[order].astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        pair, order = pair[start], order[start]
        first, second = first[order], second[order]
        # A byte holds nearly every count; 255 refers to the few larger ones.
        many = np.flatnonzero(c >= 255)
        store.save(f"{path}/pair-{shard:05d}", hash=pair, count=np.minimum(c, 255).astype(np.uint8), many=np.stack([many, c[many]]))
        keys, code = np.unique(first, return_inverse=True)
        kinds = np.stack([np.bincount(code[m], minlength=len(keys)) for m in (c == 1, c == 2, c > 2)]).astype(np.uint32)
        frequent = np.isin(keys, np.array(hot, np.uint64))
        store.save(f"{path}/first-{shard:05d}", hash=keys[~frequent], kinds=kinds[:, ~frequent])
        follow, k = summed(second, np.ones(len(second), np.int64))
        out = {"kind": [], "shard": [], "v": [], "w": [], "c": [], "n": []}
        for batch in _rows(None, follow, k, shard_of(follow, shards).astype(np.int64) // _width(shards)):
            out = {"kind": [0] * batch.num_rows, **{x: batch.column(x).to_pylist() for x in ("shard", "v", "w", "c")}, "n": [[0] * 4] * batch.num_rows}
        last = {"kind": 1, "shard": shard, "v": b"", "w": keys[frequent].tobytes(), "c": kinds[:, frequent].astype(np.int64).tobytes(), "n": [int((c == i).sum()) for i in (1, 2, 3, 4)]}
        return {x: pa.array([*out[x], last[x]], t) for x, t in zip(out, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())))}

    merged = settle(_by_shard(_count(docs, shards, hot), shards, merge_pairs, "kind int, shard int, v binary, w binary, c binary, n array<long>"))
    own = merged.filter("kind = 1")
    there["pair"] = there["first"] = _listed(own, shards)
    counts = [x or 0 for x in own.agg(*(F.sum(F.col("n")[i]) for i in range(4))).first()]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(w, np.int64)), *(pa.array(x) for x in np.frombuffer(c, np.int64).reshape(3, -1))], ["w", "k1", "k2", "k3"])

    stats = dict.fromkeys(hot, (0, 0, 0))
    found = own.select("w", "c").mapInArrow(unpack, "w long, k1 long, k2 long, k3 long").groupBy("w").agg(*(F.sum(k).alias(k) for k in ("k1", "k2", "k3")))
    stats |= {r["w"] & (1 << 64) - 1: (r["k1"], r["k2"], r["k3"]) for r in found.collect()}

    def merge_follow(shard: int, table: pa.Table) -> dict:
        w, k = summed(_column(table, "w", np.uint64), _column(table, "c", np.uint32).astype(np.int64))
        store.save(f"{path}/follow-{shard:05d}", hash=w, count=k)
        return {"shard": pa.array([shard], pa.int32()), "k": [int(k.sum())], "n": pa.array([[int((k == i).sum()) for i in (1, 2, 3, 4)] + [int((k > 2).sum())]], pa.list_(pa.int64()))}

    rows = settle(_by_shard(_fine(merged.filter("kind = 0").select("shard", "v", "w", "c"), shards, None), shards, merge_follow, "shard int, k long, n array<long>"))
    there["follow"] = _listed(rows, shards)
    total, *m = (x or 0 for x in rows.agg(F.sum("k"), *(F.sum(F.col("n")[i]) for i in range(5))).first())
    return Model(path, shards, hot, tuple((key, *stats[key]) for key in hot), n, v, n_docs, total, there, discounts(*counts), discounts(*m[:4]), (m[0], m[1], m[4]))


def _listed(rows: DataFrame, shards: int) -> np.ndarray:
    """Which shards have rows: one byte for each on the driver."""
    there = np.zeros(shards, bool)
    for r in rows.select("shard").distinct().toLocalIterator():
        there[r["shard"]] = True
    return there


class Scorer:
    """Looks up and combines the arrays of a model; inputs are distinct and ascending."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.hot = np.array(model.hot, np.uint64)
        self.hot_stats = np.array([x[1:] for x in model.hot_stats], np.int64).reshape(len(self.hot), 3)

    def _shards(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(shard, kind="stable")
        found, start = np.unique(shard[order], return_index=True)
        bounds = np.append(start, len(order))
        for k, lo, hi in zip(found.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            yield k, order[lo:hi]

    def _lookup(self, kind: str, value: str, keys: np.ndarray, shard: np.ndarray, rows: int = 0) -> np.ndarray:
        """Values of the keys, 0 where there is none."""
        out = np.zeros((rows, len(keys)) if rows else len(keys), np.int64)
        for k, own in self._shards(shard):
            if self.m.there[kind][k]:
                hashes, values = (store.load(f"{self.m.path}/{kind}-{k:05d}", x) for x in ("hash", value))
                at, there = store.find(hashes, keys[own])
                if rows:
                    out[:, own[there]] = values[:, at[there]]
                else:
                    c = values[at[there]].astype(np.int64)
                    if kind == "pair" and (c == 255).any():
                        places, counts = store.load(f"{self.m.path}/{kind}-{k:05d}", "many")
                        c[c == 255] = counts[np.searchsorted(places, at[there][c == 255])]
                    out[own[there]] = c
        return out

    def tokens(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training counts and lower-order probabilities."""
        m = self.m
        shard = shard_of(w, m.shards)
        c, k = self._lookup("token", "count", w, shard), self._lookup("follow", "count", w, shard)
        uniform = 1 / (m.v + 1)
        if not m.k:
            return c, np.full(len(w), uniform)
        d = np.array([0, *m.token_discounts])[np.minimum(k, 3)]
        rest = sum(a * b for a, b in zip(m.token_discounts, m.token_counts)) / m.k
        return c, (k - d) / m.k + rest * uniform

    def contexts(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Times that each token stands before another, and its interpolation weight."""
        m = self.m
        total = self._lookup("token", "count", v, shard_of(v, m.shards))
        total[v == np.uint64(BEGIN)] = m.docs
        kinds = self._lookup("first", "kinds", v, shard_of(v, m.shards), rows=3)
        at, there = store.find(self.hot, v)
        kinds[:, there] = self.hot_stats[at[there]].T
        return total, (np.array(m.pair_discounts) @ kinds) / np.maximum(total, 1)

    def pairs(self, v: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of pairs, and what the discount leaves of them."""
        c = self._lookup("pair", "count", pair, self.m.pair_shard(v, pair))
        return c, c - np.array([0, *self.m.pair_discounts])[np.minimum(c, 3)]

    def score(self, slices: list[Slice]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each token of each slice: training count and log10 probability after the token before it."""
        both = np.unique(np.concatenate([x.both for x in slices]))
        c, lower = self.tokens(both)
        total, weight = self.contexts(both)
        pair, first = np.unique(np.concatenate([x.pair for x in slices]), return_index=True)
        _, left = self.pairs(np.concatenate([x.both[x.v] for x in slices])[first], pair)
        for x in slices:
            at = np.searchsorted(both, x.both)
            v, w = at[x.v], at[x.w]
            p = np.where(total[v] > 0, left[np.searchsorted(pair, x.pair)] / np.maximum(total[v], 1) + weight[v] * lower[w], lower[w])
            yield c[at][x.code], np.log10(p)[x.back]


class Slice:
    """The tokens of a slice of texts: distinct ones and pairs, and where they stand."""

    def __init__(self, ids: pa.Array, text: pa.Array) -> None:
        self.ids = ids
        h, row = tokens(text)
        v = before(h, row)
        self.n = np.bincount(row, minlength=len(ids))
        self.both, code = np.unique(np.concatenate([h, v]), return_inverse=True)
        code = code.astype(np.int32)
        # Copies, as a view would hold both halves.
        self.code = code[: len(h)].copy()
        self.pair, first, back = np.unique(tc.combine(v, h), return_index=True, return_inverse=True)
        self.back = back.astype(np.int32)
        self.v, self.w = code[len(h) :][first], self.code[first]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of whole texts, with those of an add-0.1 unigram model beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        held, size = [], 0
        for batch in batches:
            key, text = batch.column(0), batch.column(1)
            for lo, hi in tc.slices(text):
                held.append(Slice(key.slice(lo, hi - lo), text.slice(lo, hi - lo)))
                size += len(held[-1].code)
                if size >= ROUND:
                    yield from _scored(scorer, held)
                    held, size = [], 0
        if held:
            yield from _scored(scorer, held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _scored(scorer: Scorer, slices: list[Slice]) -> Iterator[pa.RecordBatch]:
    """A batch of rows for each slice; the model's arrays are visited once for all."""
    model = scorer.m
    for x, (c, log_p) in zip(slices, scorer.score(slices)):
        base = np.log10((c + 0.1) / (model.n + 0.1 * (model.v + 1)))
        row, n = np.repeat(np.arange(len(x.n)), x.n), len(x.n)
        total = lambda y: np.bincount(row, weights=y, minlength=n)  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays(
            [
                x.ids,
                pa.array([held_out(i) for i in x.ids.to_pylist()], pa.bool_()),
                pa.array(x.n),
                pa.array(total(c > 0).astype(np.int64)),
                pa.array(np.full(n, model.n)),
                pa.array(total(base)),
                pa.array(total(log_p)),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


def in_training(doc_id: str = "doc_id") -> Column:
    """The rule of ``held_out`` as an expression; an id that is null counts as the text None."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("None")).cast("binary")) % 10 != 0


def train_and_score(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and scores all of them."""
    return score(docs, train(docs.filter(in_training())))

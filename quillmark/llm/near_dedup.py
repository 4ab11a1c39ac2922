"""Near-duplicate groups by an LSH forest over MinHash signatures.

A document's set holds its distinct 5-word shingles (A-Z in lower case); a text
of fewer words is one shingle, a text without words has none.  Documents with the
same set, by a 128-bit key, form a class at once.  The forest has ``TREES`` trees;
each is one sorted order of the classes, by ``DEPTH`` signature values of its own.
An order is sorted once over range partitions, so a crowded part of it is spread
over many tasks, and neighbours in it have the longest common prefixes: a class is
a candidate with up to ``SMALL`` - 1 classes before it, or with ``CLOSE`` where its
region has more, down to a common prefix of a least number of values, which ``least_depth`` takes from the threshold.  Depth so
adapts by region, that is, by shared prefix: where few classes are, candidates
share little more than the least prefix, where many are, they share a deep one.
All candidates are confirmed on full sets.

A region of at most ``SMALL`` classes so gives all its pairs.  Links that larger
regions may still hide are found in a second round: confirmed links give
components, and where a large region holds several components, each of its members
outside the largest is compared with the region's members in other components, in
blocks: a pair of blocks is one row and one matrix product.  Pairs inside a
component need no check, as they cannot change it.  The second round is quadratic
in the members that a region has outside its largest component; it is what makes
the result whole where many texts are alike but not near enough.

Full sets of classes that are candidates are kept as arrays in the shared folder
and memory-mapped where pairs are confirmed, so sets never move in a shuffle.

Defined results: a null or empty text has no shingles and is linked with nothing;
repeated rows are in one class; with repeated ids each row is judged by its own
text; rows without an id are linked with nothing, have no component and are kept;
an empty table gives an empty result; columns besides doc_id and text are
ignored by ``groups`` and kept by ``first_of_each``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from . import textcore as tc
from .shared import marked, parts, released, settle, shared_dir

WIDTH = 5
TREES, DEPTH = 16, 8
#: A link needs 100 * intersection >= percent * union; this is the percent where none is given.
PERCENT = 85
#: Probability, at most, that a pair at exactly the threshold shares no shallowest region.
MISS = 2e-5
#: Members up to which a region gives all its pairs.
SMALL = 12
#: Nearest neighbours before a member of a larger region.
CLOSE = 2
#: Texts are handled in slices of about this many bytes.
SLICE = 2 << 20
#: Bytes of documents for each range of the sorted orders.
RANGE_BYTES = 8 << 20
#: Members in the blocks that are compared in large regions, and columns of a matrix.
OUTSIDE, INSIDE, COLUMNS = 128, 256, 4096
_FACTORS = tc.mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)


def least_depth(percent: int) -> int:
    """Values in the shallowest prefixes: as many as ``MISS`` allows."""
    fit = [d for d in range(1, DEPTH + 1) if (1 - (percent / 100) ** d) ** TREES <= MISS]
    if not fit:
        raise ValueError(f"{TREES} trees cannot find pairs of similarity {percent} %")
    return max(fit)


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within their rows, the rows, and the set size by row."""
    h, row, _, _, n = tc.words(text, lower=True)
    w, first = tc.windows(h, row, WIDTH)
    w_row = row[first]
    short = np.flatnonzero((n > 0) & (n < WIDTH))
    if len(short):
        begin = np.cumsum(n) - n
        out = tc.mix(h[begin[short]] + n[short].astype(np.uint64))
        for k in range(1, WIDTH - 1):
            more = n[short] > k
            out[more] = tc.combine(out[more], h[begin[short[more]] + k])
        w, w_row = np.concatenate([w, out]), np.concatenate([w_row, short])
    w, w_row = tc.distinct(w, w_row)
    return w, w_row, np.bincount(w_row, minlength=len(n))


def set_key(values: np.ndarray) -> bytes:
    """A 128-bit key of a set, from its ascending hashes."""
    return xxhash.xxh3_128_digest(values.tobytes())


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n, key (of the set) and signature of each document; key and signature are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.columns
            for lo, hi in tc.slices(text, SLICE):
                w, _, n = shingles(text.slice(lo, hi - lo))
                end = np.cumsum(n)
                some = np.flatnonzero(n)
                keys: list[bytes | None] = [None] * len(n)
                signs: list[bytes | None] = [None] * len(n)
                if len(some):
                    signature = np.zeros((len(some), TREES * DEPTH), ">u4")
                    begin = (end - n)[some]
                    with np.errstate(over="ignore"):
                        for k, factor in enumerate(_FACTORS):
                            signature[:, k] = np.minimum.reduceat(((w * factor) >> np.uint64(32)).astype(np.uint32), begin)
                    for j, i in enumerate(some.tolist()):
                        keys[i] = set_key(w[end[i] - n[i] : end[i]])
                        signs[i] = signature[j].tobytes()
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "n", "key", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, n long, key binary, signature binary")


def orders(classes: DataFrame) -> DataFrame:
    """A row for each class and tree: place (the tree, then its signature values, as bytes that sort), v and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 + 4 * DEPTH
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                v, n, signature = part.columns
                place = np.empty((part.num_rows, TREES, size), np.uint8)
                place[:, :, 0] = np.arange(TREES, dtype=np.uint8)
                place[:, :, 1:] = np.frombuffer(b"".join(signature.to_pylist()), np.uint8).reshape(-1, TREES, size - 1)
                times = pa.array(np.repeat(np.arange(part.num_rows), TREES))
                rows = part.num_rows * TREES
                flat = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((np.arange(rows + 1) * size).astype(np.int32)), pa.py_buffer(place.tobytes())])
                yield pa.RecordBatch.from_arrays([flat, v.take(times), n.take(times)], ["place", "v", "n"])

    return classes.select("v", "n", "signature").mapInArrow(released(run), "place binary, v binary, n long")


def region(least: int) -> Column:
    """The shallowest prefix of a row of ``orders``."""
    return F.substring("place", 1, 1 + 4 * least)


def neighbours(rows: DataFrame, ranges: int, least: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) by longest common prefix, and the large regions (r).

    ``rows`` are sorted within ranges; a task compares each row with the ones
    before it and passes on what stands at its edges, the length of its range and
    the regions that hold several of its rows or reach an edge.
    """
    reach, prefix = SMALL - 1, 1 + 4 * least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        place, v, n = np.zeros((0, 1 + 4 * DEPTH), np.uint8), [], np.zeros(0, np.int64)
        head: list[tuple] = []
        run_of, run_n, first_run = b"", 0, True

        def rows_of(kind: int, items: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*items))
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(items), pa.int32()), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array([part] * len(items), pa.int32()), pa.array(cols[3], pa.int64())], ["kind", "a", "b", "n", "part", "c"])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            held = len(v)
            place, v, n = np.concatenate([place, own]), v + batch.column(1).to_pylist(), np.concatenate([n, batch.column(2).to_numpy()])
            alike = np.arange(held, len(v))
            pairs: list[tuple] = []
            fresh = np.ones(len(own), bool)
            for k in range(1, reach + 1):
                alike = alike[alike >= k]
                alike = alike[(place[alike - k, :prefix] == place[alike, :prefix]).all(1)]
                if k == 1:
                    fresh[alike - held] = False
                    # Rows of the same region before each row: in a region that is large by then, the closest ones are enough.
                    begun = np.maximum.accumulate(np.where(fresh, np.arange(len(own)), -1))
                    earlier = np.where(begun < 0, run_n + np.arange(len(own)), np.arange(len(own)) - begun)
                elif k == CLOSE + 1:
                    alike = alike[earlier[alike - held] < SMALL]
                x, y = n[alike - k], n[alike]
                near = alike[100 * np.minimum(x, y) >= percent * np.maximum(x, y)]
                pairs += [(v[i - k], v[i], 0, 0) for i in near.tolist()]
            if pairs:
                yield rows_of(0, pairs)
            # Runs of one region: those of several rows, and those at the range's edges.
            starts = np.flatnonzero(fresh)
            counts = []
            if len(starts) == 0:
                run_n += len(own)
            else:
                run_n += int(starts[0])
                if total and (run_n > 1 or first_run):
                    counts.append((run_of, None, 0, run_n))
                first_run = first_run and not total and len(starts) == 1
                sizes = np.diff(starts)
                if not total and len(starts) > 1:
                    counts.append((own[0, :prefix].tobytes(), None, 0, int(sizes[0])))
                    several = 1 + np.flatnonzero(sizes[1:] > 1)
                else:
                    several = np.flatnonzero(sizes > 1)
                counts += [(own[starts[i], :prefix].tobytes(), None, 0, int(sizes[i])) for i in several.tolist()]
                run_of, run_n = own[starts[-1], :prefix].tobytes(), len(own) - int(starts[-1])
            if counts:
                yield rows_of(2, counts)
            if len(head) < reach:
                head += [(own[i].tobytes(), v[held + i], int(n[held + i]), total + i) for i in range(min(len(own), reach - len(head)))]
            total += len(own)
            place, v, n = place[-reach:], v[-reach:], n[-reach:]
        if total:
            yield rows_of(2, [(run_of, None, 0, run_n)])
            yield rows_of(3, head)
            yield rows_of(4, [(place[i].tobytes(), v[i], int(n[i]), len(v) - 1 - i) for i in range(len(v))])
            yield rows_of(5, [(None, None, 0, total)])

    ranged = rows.repartitionByRange(ranges, "place", "v").sortWithinPartitions("place", "v")
    found = settle(ranged.mapInArrow(released(run), "kind int, a binary, b binary, n long, part int, c long"))
    sizes = sorted((r["part"], r["c"]) for r in found.filter("kind = 5").select("part", "c").collect())
    across = []
    for k, (p, _) in enumerate(sizes):
        gap = 0
        for q, size in sizes[k + 1 :]:
            if gap >= reach:
                break
            across.append((p, q, gap))
            gap += size
    edge = lambda kind, x: found.filter(F.col("kind") == kind).select(F.col("part").alias(f"p{x}"), F.col("a").alias(f"place{x}"), F.col("b").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}"))
    spark = rows.sparkSession
    links = spark.createDataFrame(across, "p int, q int, gap long")
    over = edge(4, "a").join(links, F.col("pa") == F.col("p")).join(edge(3, "b"), (F.col("q") == F.col("pb")) & (F.col("ca") + F.col("gap") + F.col("cb") < reach) & (F.substring("placea", 1, prefix) == F.substring("placeb", 1, prefix)))
    over = over.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = found.filter("kind = 0").select("a", "b").union(over.select("a", "b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    large = found.filter("kind = 2").groupBy(F.col("a").alias("r")).agg(F.sum("c").alias("size")).filter(F.col("size") > SMALL).select("r")
    return pairs, large


def write_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sets of the wanted classes as arrays: v, place, start.

    ``wanted`` has v and first (the id of a member).  Documents are picked by marked
    ids where they are read; a set that is written without need does no harm.
    """
    path = f"{shared_dir(docs.sparkSession)}/sets-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            place = f"{path}/{uuid.uuid4().hex}"
            store.save(place, set=np.concatenate([w for _, w in held]))
            n = np.array([len(w) for _, w in held])
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.binary()), pa.array([place] * len(held)), pa.array(np.cumsum(n) - n)], ["v", "place", "start"])

        for batch in batches:
            text = batch.column(0)
            for lo, hi in tc.slices(text, SLICE):
                w, _, n = shingles(text.slice(lo, hi - lo))
                end = np.cumsum(n)
                for i in np.flatnonzero(n).tolist():
                    own = w[end[i] - n[i] : end[i]].copy()
                    held.append((set_key(own), own))
                    size += len(own)
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = marked(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted.select("first"), "first")
    sets = settle(rows.filter("__marked").select("text").mapInArrow(released(run), "v binary, place string, start long"))
    return sets.groupBy("v").agg(F.min(F.struct("place", "start")).alias("at")).select("v", "at.place", "at.start")


def confirm(pairs: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike."""
    where = settle(sets.join(classes.select(F.col("v").alias("w"), "n"), F.col("v") == F.col("w")).select("v", "place", "start", "n"))
    side = lambda x: where.select(*(F.col(c).alias(f"{x}_{c}") for c in ("v", "place", "start", "n")))
    rows = pairs.join(side("x"), F.col("a") == F.col("x_v")).join(side("y"), F.col("b") == F.col("y_v")).drop("x_v", "y_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            get = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            for i in range(batch.num_rows):
                x, y = (store.load(get[f"{s}_place"][i], "set")[(b := get[f"{s}_start"][i]) : b + get[f"{s}_n"][i]] for s in "xy")
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                both = int(store.find(y, x)[1].sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return rows.mapInArrow(released(run), "a binary, b binary")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """v and label: the least (first, v) that edges reach, by label passing with shortcuts."""
    both = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = settle(vertices.select("v", F.struct("first", "v").alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("other"))
        step = labels.join(near, F.col("v") == F.col("a"), "left").select("v", "label", F.least("label", F.coalesce("other", "label")).alias("next"))
        step = settle(step)
        goal = step.select(F.col("v").alias("u"), F.col("next").alias("jump"))
        after = settle(step.join(goal, F.col("next.v") == F.col("u")).select("v", (F.col("label") != F.col("jump")).alias("moved"), F.col("jump").alias("label")))
        labels = after.select("v", "label")
        if not after.filter("moved").limit(1).count():
            return labels


def _block(part: list, codes: dict[bytes, int]) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """Keys, numbers of components and sets of a block's members."""
    c = np.array([codes.setdefault(x["c"], len(codes)) for x in part], np.int64)
    return [x["v"] for x in part], c, [store.load(x["place"], "set")[x["start"] : x["start"] + x["n"]] for x in part]


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two blocks of sets, as products of 0/1 matrices, some columns at a time."""
    vocabulary = np.unique(np.concatenate(x))
    sides = []
    for sets in (x, y):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at, there = store.find(vocabulary, np.concatenate(sets))
        at, row = at[there], row[there]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], row[order]))
    out = np.zeros((len(x), len(y)), np.float64)
    for lo in range(0, len(vocabulary), COLUMNS):
        some = []
        for (at, row), size in zip(sides, (len(x), len(y))):
            i, j = np.searchsorted(at, [lo, lo + COLUMNS])
            m = np.zeros((size, COLUMNS), np.float32)
            m[row[i:j], at[i:j] - lo] = 1
            some.append(m)
        out += some[0] @ some[1].T
    return out


def hidden(large: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components that large regions hide.

    Members outside a region's largest component are compared with all its members
    block by block.  A pair of blocks is one row and one matrix product; of the
    links of a member with another component one is returned, as more change nothing.
    ``large`` has a row (v, n, region) for each member of a large region.
    """
    own = large.join(labels.select(F.col("v").alias("u"), F.col("label.v").alias("c")), F.col("v") == F.col("u"), "left").select("v", "n", "region", F.coalesce("c", "v").alias("c"))
    own = settle(own.join(sets.withColumnRenamed("v", "w"), F.col("v") == F.col("w")).select("v", "n", "region", "c", "place", "start"))
    counts = own.groupBy("region", "c").agg(F.count(F.lit(1)).alias("k"))
    main = counts.groupBy("region").agg(F.max(F.struct("k", "c")).alias("m"), F.sum("k").alias("all"), F.count(F.lit(1)).alias("several")).filter("several > 1").select(F.col("region").alias("r"), F.col("m.c").alias("main"), F.col("all"), (F.col("all") - F.col("m.k")).alias("outside"))
    own = own.join(main, F.col("region") == F.col("r")).drop("r")
    member = F.struct("v", "c", "place", "start", "n")
    deal = lambda seed, total, size: F.pmod(F.xxhash64(F.lit(seed), "v"), F.ceil(total / size)).cast("int")
    left = own.filter("c <> main").groupBy("region", deal(1, F.col("outside"), OUTSIDE).alias("i")).agg(F.collect_list(member).alias("x"))
    right = own.groupBy(F.col("region").alias("r"), deal(2, F.col("all"), INSIDE).alias("j")).agg(F.collect_list(member).alias("y"))
    items = left.join(right, F.col("region") == F.col("r")).select("region", "i", "j", "x", "y")
    items = items.repartition(F.xxhash64("region", "i", "j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                codes: dict[bytes, int] = {}
                (v, c, x), (u, d, y) = _block(row["x"], codes), _block(row["y"], codes)
                both = overlaps(x, y)
                n, m = np.array([len(s) for s in x]), np.array([len(s) for s in y])
                linked = (100 * both >= percent * (n[:, None] + m[None] - both)) & (c[:, None] != d[None])
                a, b = np.nonzero(linked)
                if len(a):
                    first = np.unique(np.stack([a, d[b]]), axis=1, return_index=True)[1]
                    ends = [(v[i], u[j]) for i, j in zip(a[first].tolist(), b[first].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array([min(e) for e in ends], pa.binary()), pa.array([max(e) for e in ends], pa.binary())], ["a", "b"])

    return items.select("x", "y").mapInArrow(released(run), "a binary, b binary")


def assigned(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, key, component (its smallest id) and c (the component's own key) of each row; without words, no component."""
    least = least_depth(percent)
    sketches = settle(sketch(docs))
    classes = settle(sketches.filter("n > 0 and doc_id is not null").groupBy(F.col("key").alias("v")).agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("signature").alias("signature")))
    rows = orders(classes)
    pairs, large = neighbours(rows, parts(docs, RANGE_BYTES, least=1), least, percent)
    pairs, large = settle(pairs), settle(large)
    members = classes.select("v", "first", "n")
    crowded = settle(rows.select("v", "n", region(least).alias("region")).join(large, F.col("region") == F.col("r")).drop("r"))
    touched = pairs.select(F.col("a").alias("t")).union(pairs.select(F.col("b").alias("t"))).union(crowded.select(F.col("v").alias("t"))).distinct()
    some = settle(members.join(touched, F.col("v") == F.col("t"), "left_semi"))
    sets = write_sets(docs, some)
    edges = settle(confirm(pairs, sets, members, percent))
    labels = components(some, edges)
    if crowded.limit(1).count():
        more = settle(hidden(crowded, labels, sets, percent))
        if more.limit(1).count():
            labels = components(some, edges.union(more))
    of = labels.select(F.col("v").alias("u"), F.col("label.first").alias("component"), F.col("label.v").alias("c"))
    of_class = members.join(of, F.col("v") == F.col("u"), "left").select("v", F.coalesce("component", "first").alias("component"), F.coalesce("c", "v").alias("c"))
    return sketches.select("doc_id", "n", "key").join(of_class, F.col("key") == F.col("v"), "left").select("doc_id", "n", "key", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"), F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("c"))


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document."""
    out = assigned(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def with_key(rows: DataFrame) -> DataFrame:
    """``rows`` with __key, the key of the text's set, null without words."""
    names = [c for c in rows.columns if c != "text"]
    packed = rows.select(F.struct(*(f"`{c}`" for c in names)).alias("rest"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            for lo, hi in tc.slices(text, SLICE):
                w, _, n = shingles(text.slice(lo, hi - lo))
                end = np.cumsum(n)
                keys = [set_key(w[end[i] - n[i] : end[i]]) if n[i] else None for i in range(len(n))]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], names=["rest", "text", "__key"])

    kinds = f"rest {packed.schema['rest'].dataType.simpleString()}, text string, __key binary"
    return packed.mapInArrow(released(run), kinds).select(*("text" if c == "text" else f"rest.`{c}`" for c in rows.columns), "__key")


def first_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents with one row of each group: one of those with the group's smallest id.

    Rows are judged by id and text.  Only rows whose id is marked, as that of a row
    which leaves or of several rows with one id, get their key and are joined.
    """
    found = settle(assigned(docs, percent).filter("component is not null"))
    leaves = found.filter("doc_id <> component").select("doc_id", "key")
    several = found.filter("doc_id = component").groupBy("c").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("c").alias("__c"))
    again = found.filter("doc_id = component").join(several, F.col("c") == F.col("__c")).select("doc_id", "key", "c").distinct()
    doubt = settle(leaves.select("doc_id", "key", F.lit(None).cast("binary").alias("c")).union(again).select(F.col("doc_id").alias("__id"), F.col("key").alias("__k"), F.col("c").alias("__group"), F.lit(True).alias("__there")).distinct())
    rows = marked(docs, doubt.select("__id"), "__id")
    sure = rows.filter(~F.col("__marked")).select(*docs.columns)
    judged = with_key(rows.filter("__marked").drop("__marked")).join(doubt, (F.col("doc_id") == F.col("__id")) & (F.col("__key") == F.col("__k")), "left")
    alone = judged.filter("__there is null").select(*docs.columns)
    one = judged.filter("__group is not null").dropDuplicates(["__group"]).select(*docs.columns)
    return sure.unionByName(alone).unionByName(one)

"""Line dedup by a segment-partition edit join.

Native: DataFrame functions only.  Lines of at least ``MIN_CHARS`` characters,
trimmed and in lower case, take part; others always stay.  The first occurrence of
a line is the one of the smallest (doc_id, place, hash of the whole text).  A line is removed where it is
not the first occurrence of its text, and wherever a line near it has an earlier
first occurrence.  Two lines are near within as many edits as the shorter one has
``PER_EDIT`` characters, at least one and at most ``edits``, a parameter; with its
default of one, any two lines within one edit are near.

The edit join for one edit: two lines within one edit share one of two segments.  A line of
length L has the segments [0, L/2) and [L/2, L); as a prober it looks for partners
of its own length and one less, so four keys (target length, side, substring hash)
stand for it.  Keys that several lines have form buckets.  A bucket of up to
``SMALL`` lines gives its pairs.  A larger one is split again: what the shared
segment leaves unmatched is parted in two in the same way, until buckets are small
or at most one character is unmatched; then all lines of the target length are
within one edit of each other and pairs with the first of them are enough.  Pairs
are verified with the built-in banded edit distance with a threshold.  No bucket is
cut short, and no bucket gives all its pairs unless it is small.

The edit join for k edits: classes of lengths, of the shorter line, fix k and a
segment size a, so that k + 1 segments fit; some stand at the line's start, the
others at its end.  One side has fewer edits than segments.  If its segments are
counted from outside, one of them, the i-th from zero, is intact with exactly i
edits outside of it, so it stands in the other line at most i characters further
in or out.  Each line gives its segments at all these shifts as keys, about
(k + 1)^2 / 2 of them, whatever the partner's length; a line just above a class's
least length also gives those of the classes that shorter partners may be in.  Large buckets are compared with
their first line, and only members that no line removes yet with all earlier ones
of lengths that the edits allow.  A pair's edit distance is taken only where signatures of
hashed words and of counted characters differ in no more bits than the edits can change.

Texts move between tasks only where they lose lines: bitmaps of bounded size mark
the lines and the documents that may be concerned where they are read.

Defined results: a null text stays null and has no lines; rows with the same id
and text count as one document, whose places they share; rows with the same id and
different texts are documents of their own; documents that lose all their lines
keep an empty text; an empty table gives an empty result; other columns are kept
by ``clean``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import marked, settle

MIN_CHARS = 20
EDIT = 1
#: Characters of the shorter line for each edit, where more than one is asked for.
PER_EDIT = 12
SMALL = 32
#: Characters up to which the built-in distance, quadratic in them, is the faster one (as measured on check_s).
WALKED = 1000
#: 64-bit parts of the signature of a line's words, and how many of its bits one edit can change at most.
PARTS, PER_CHANGE = 4, 3
#: Characters whose counts, modulo 8, make the second signature: four bits each, of which a change of one turns one.
COUNTED = "abcdefghijklmnopqrstuvwxyz .,-01"
#: The cyclic code of a count modulo 8: neighbours differ in one bit, so codes differ in no more bits than counts differ by.
CYCLE = (0b0000, 0b0001, 0b0011, 0b0111, 0b1111, 0b1110, 0b1100, 0b1000)
#: Columns of both signatures.
SIGNED = tuple(f"g{p}" for p in range(PARTS)) + tuple(f"n{p}" for p in range(len(COUNTED) // 16))
#: Documents up to which the places to fetch are broadcast; beyond it, they are joined by shuffle.
BROADCAST_ROWS = 200_000


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, h (of the whole text) and line of each line that takes part."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", "h", F.trim(F.lower("line")).alias("line")).filter(F.length("line") >= MIN_CHARS)


def _segments(line: Column, goal: Column, seed: Column) -> tuple[Column, Column, Column, Column]:
    """Keys of both segments for a partner of length ``goal``, and what each leaves unmatched."""
    half = F.floor(goal / 2).cast("int")
    tail = (goal - half).cast("int")
    n = F.length(line)
    left = F.xxhash64(seed, F.lit(1), goal, F.substring(line, F.lit(1), half))
    right = F.xxhash64(seed, F.lit(2), goal, F.substring(line, n - tail + 1, tail))
    return left, right, F.substring(line, half + 1, n), F.substring(line, F.lit(1), n - tail)


def _keys(line: Column) -> Column:
    n = F.length(line)
    seed = F.lit(0)
    return F.array(*(k for goal in (n, n - 1) for k in _segments(line, goal, seed)[:2]))


def distinct_lines(docs: DataFrame, edits: int = EDIT) -> DataFrame:
    """h1, h2 (128 bits of a line's hash), first (doc_id, pos, h) and copies of each distinct line, with size and keys, or line where ``edits`` is above one."""
    line = F.col("line")
    if edits > 1:
        rows = _lines(docs).select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "line", "doc_id", "pos", "h")
        return rows.groupBy("h1", "h2", "line").agg(F.min(F.struct("doc_id", "pos", "h")).alias("first"), F.count(F.lit(1)).alias("copies"))
    rows = _lines(docs).select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc_id", "pos", "h", F.length("line").alias("size"), *(_keys(line)[k].alias(f"k{k}") for k in range(4)))
    return rows.groupBy("h1", "h2", "size", *(f"k{k}" for k in range(4))).agg(F.min(F.struct("doc_id", "pos", "h")).alias("first"), F.count(F.lit(1)).alias("copies"))


def fetch(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The texts of the lines at the given places: first, line."""
    places = firsts.groupBy(F.col("first.doc_id").alias("i"), F.col("first.h").alias("j")).agg(F.collect_set("first.pos").alias("at"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    if firsts.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    else:
        rows = marked(rows, places, "j", "h").filter("__marked").drop("__marked")
    found = rows.join(places, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j")))
    found = found.select("doc_id", "h", F.split("text", "\n").alias("lines"), F.explode("at").alias("pos"))
    return found.select(F.struct("doc_id", "pos", "h").alias("first"), F.trim(F.lower(F.get("lines", F.col("pos")))).alias("line")).groupBy("first").agg(F.min("line").alias("line"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _within(a: str, b: str, most: Column, edits: int) -> Column:
    """Whether the edit distance of two columns is at most ``most``, which is at most ``edits``.

    The built-in distance walks over a line for each of its characters.  Longer
    lines go by diagonals: with each further edit every diagonal reaches one
    character further, and from there as far as both lines agree, which is found by
    halving.  So time grows with the length, not with its square.
    """

    def reaches(x: Column, y: Column) -> Column:
        n, m = (F.floor(F.octet_length(c) / 4).cast("int") for c in (x, y))
        return _bound(F.struct(n.alias("n"), m.alias("m"), F.filter(F.array(*(F.lit(1 << p) for p in range(29, -1, -1))), lambda w: w <= F.least(n, m)).alias("steps")), lambda s: by_edits(x, y, s["n"], s["m"], s["steps"]))

    def by_edits(x: Column, y: Column, n: Column, m: Column, steps: Column) -> Column:
        def agree(i: Column, j: Column) -> Column:
            same = lambda p, w: F.substring(x, (i + p) * 4 + 1, w * 4) == F.substring(y, (j + p) * 4 + 1, w * 4)
            short = F.filter(F.array(F.lit(4), F.lit(2), F.lit(1)), lambda w: w <= F.least(n, m))
            return F.aggregate(F.when(same(F.lit(0), F.lit(8)), steps).otherwise(short), F.lit(0), lambda p, w: F.when((p + w <= F.least(n - i, m - j)) & same(p, w), p + w).otherwise(p))

        def further(reach: Column, d: Column) -> Column:
            at = F.least(F.greatest(F.get(reach, d + edits) + 1, F.get(reach, d + edits - 1), F.get(reach, d + edits + 1) + 1), n, m - d)
            return _bound(at, lambda i: F.when((i >= 0) & (i + d >= 0), i + agree(i, i + d)).otherwise(none))

        none = F.lit(-(1 << 29))
        diagonals = F.array(*(F.lit(d) for d in range(-edits, edits + 1)))
        start = F.array(*(agree(F.lit(0), F.lit(0)) if d == 0 else none for d in range(-edits, edits + 1)))
        grown = F.aggregate(F.sequence(F.lit(1), most), start, lambda reach, e: F.when(F.get(reach, m - n + edits) >= n, reach).otherwise(F.transform(diagonals, lambda d: F.when((F.abs(d) <= e) & (F.abs(m - n - d) <= most - e), further(reach, d)).otherwise(none))))
        return (F.abs(m - n) <= most) & (F.get(grown, m - n + edits) >= n)

    wide = _bound(F.struct(F.encode(a, "UTF-32").alias("x"), F.encode(b, "UTF-32").alias("y")), lambda s: reaches(s["x"], s["y"]))
    return F.when(F.greatest(F.length(a), F.length(b)) <= WALKED, F.call_function("levenshtein", F.col(a), F.col(b), most) >= 0).otherwise(wide)


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs of a bucket's rows, one of the target length and one of it or one more."""
    x = rows.filter("length(rest) = goal").select(F.col("key").alias("k"), F.col("first").alias("a"), F.col("line").alias("line_a"))
    y = rows.select(F.col("key").alias("k2"), F.col("first").alias("b"), F.col("line").alias("line_b"), (F.length("rest") == F.col("goal")).alias("even"))
    return x.join(y, (F.col("k") == F.col("k2")) & (~F.col("even") | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b"))).select("a", "line_a", "b", "line_b")


def _last_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of a bucket with at most one unmatched character: linear in its size."""
    even = rows.filter("length(rest) = goal")
    tops = even.groupBy("key").agg(F.min(F.struct("first", "line")).alias("top"))
    star = even.join(tops, "key").filter("first <> top.first").select(F.col("top.first").alias("a"), F.col("top.line").alias("line_a"), F.col("first").alias("b"), F.col("line").alias("line_b"))
    # A line with one character more contains the other's rest: at most one such line for each character.
    x = even.select(F.col("key").alias("k"), F.col("rest").alias("c"), F.col("first").alias("a"), F.col("line").alias("line_a"))
    parts = F.when(F.col("goal") == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.array(F.substring("rest", 1, 1), F.substring("rest", 2, 1))))
    y = rows.filter("length(rest) > goal").select(F.col("key").alias("k2"), F.explode(parts).alias("c2"), F.col("first").alias("b"), F.col("line").alias("line_b"))
    return star.union(x.join(y, (F.col("k") == F.col("k2")) & (F.col("c") == F.col("c2"))).select("a", "line_a", "b", "line_b"))


def near_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``first`` of the distinct lines that are within one edit of a line that comes earlier."""
    keyed = lines.select("first", "size", F.explode(F.array(*(F.struct(F.col(f"k{k}").alias("key"), F.lit(k % 2).alias("side"), (F.col("size") - k // 2).alias("goal")) for k in range(4)))).alias("s")).select("first", "size", "s.*")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(F.col("size") - F.col("goal")).alias("least")).filter("members > 1 and least = 0").select(F.col("key").alias("k"), "members")
    rows = settle(keyed.join(shared, F.col("key") == F.col("k")).drop("k"))
    texts = settle(fetch(docs, rows.select("first").distinct()))
    texts = texts.withColumnRenamed("first", "f")
    rows = rows.join(texts, F.col("first") == F.col("f")).drop("f")
    _, _, after, before = _segments(F.col("line"), F.col("goal"), F.lit(0))
    half = F.floor(F.col("goal") / 2).cast("int")
    rows = rows.select("key", "members", "first", "line", F.when(F.col("side") == 0, after).otherwise(before).alias("rest"), F.when(F.col("side") == 0, F.col("goal") - half).otherwise(half).cast("int").alias("goal"))
    found = None
    while True:
        rows = settle(rows)
        small = _pairs(rows.filter(F.col("members") <= SMALL))
        found = small if found is None else found.union(small)
        large = rows.filter(F.col("members") > SMALL)
        if not large.limit(1).count():
            break
        found = found.union(_last_pairs(large.filter("goal <= 1")))
        left, right, after, before = _segments(F.col("rest"), F.col("goal"), F.col("key"))
        half = F.floor(F.col("goal") / 2).cast("int")
        sides = F.array(F.struct(left.alias("key"), after.alias("rest"), (F.col("goal") - half).alias("goal")), F.struct(right.alias("key"), before.alias("rest"), half.alias("goal")))
        parts = large.filter("goal > 1").select("first", "line", F.explode(sides).alias("s")).select("first", "line", "s.*")
        sizes = parts.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(F.length("rest") - F.col("goal")).alias("least")).filter("members > 1 and least = 0").select(F.col("key").alias("k"), "members")
        rows = parts.join(sizes, F.col("key") == F.col("k")).select("key", "members", "first", "line", "rest", "goal")
    near = found.filter(F.levenshtein("line_a", "line_b", EDIT).between(0, EDIT) & (F.col("line_a") != F.col("line_b")))
    return near.select(F.greatest("a", "b").alias("first")).distinct()


def _allowed(size: Column, edits: int) -> Column:
    return F.least(F.greatest(F.floor(size / PER_EDIT), F.lit(1)), F.lit(edits)).cast("int")


def _shapes(k: int) -> list[tuple[int, int, int]]:
    """Side (0 start, 1 end), number from outside and shift of each key for ``k`` edits; those for fewer edits are among them."""
    counts = ((k + 2) // 2, (k + 1) // 2)
    return [(side, i, s) for side in (0, 1) for i in range(counts[side]) for s in range(-i, i + 1)]


def _classes(edits: int) -> list[int]:
    """Least lengths of the classes; a class has one number of edits."""
    least = [MIN_CHARS, *(PER_EDIT * k for k in range(2, edits + 1) if PER_EDIT * k > MIN_CHARS)]
    while least[-1] < 1 << 30:
        least.append(least[-1] * 3 // 2)
    return least


def shifted_keys(lines: DataFrame, edits: int) -> DataFrame:
    """h1, key and own (whether the segment stands unshifted) of the lines' segments, from the class of the shortest partner on."""
    classes = F.array(*map(F.lit, _classes(edits)))
    shapes = F.array(*(F.struct(F.lit(side).alias("side"), F.lit(i).alias("i"), F.lit(s).alias("s")) for side, i, s in _shapes(edits)))
    rows = lines.select("h1", "line", F.length("line").alias("n"))
    # The largest class up to n - edits, or the first one, and those after it up to n.
    low = F.greatest(F.size(F.filter(classes, lambda c: c <= F.col("n") - edits)), F.lit(1))
    rows = rows.select("h1", "line", "n", F.explode(F.filter(F.slice(classes, low, F.lit(edits + 1)), lambda c: c <= F.col("n"))).alias("c"))
    rows = rows.withColumn("k", _allowed(F.col("c"), edits)).withColumn("a", F.floor(F.col("c") / (F.col("k") + 1)).cast("int"))
    rows = rows.select("h1", "line", "n", "c", "k", "a", F.explode(shapes).alias("x")).filter(F.col("x.i") < F.floor((F.col("k") + 2 - F.col("x.side")) / 2))
    at = F.when(F.col("x.side") == 0, F.col("x.i") * F.col("a")).otherwise(F.col("n") - (F.col("x.i") + 1) * F.col("a")) + F.col("x.s")
    return rows.select("h1", F.xxhash64("c", "x.side", "x.i", F.substring("line", at + 1, F.col("a"))).alias("key"), (F.col("x.s") == 0).alias("own"))


def _signature(line: Column) -> Column:
    """An array of the signature's parts: bits of a line's hashed words.  A one-element transform binds the places, which are else evaluated anew for each use."""
    places = F.transform(F.split(line, " "), lambda w: F.pmod(F.xxhash64(w), F.lit(64 * PARTS)).cast("int"))

    def part(p: int, at: Column) -> Column:
        own = F.filter(at, lambda g: (g >= 64 * p) & (g < 64 * (p + 1)))
        return F.aggregate(own, F.lit(0).cast("long"), lambda m, g: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), g - 64 * p)))

    return F.get(F.transform(F.array(places), lambda at: F.array(*(part(p, at) for p in range(PARTS)))), F.lit(0))


def _counts(line: Column) -> list[Column]:
    """The signature of a line's counted characters, 16 of them in each part."""
    codes = F.array(*map(F.lit, CYCLE))

    def code(at: int) -> Column:
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(COUNTED[at]), F.lit("")))
        return F.shiftleft(F.element_at(codes, (count % 8 + 1).cast("int")).cast("long"), at % 16 * 4)

    return [sum((code(at) for at in range(16 * p + 1, 16 * (p + 1))), code(16 * p)).alias(f"n{p}") for p in range(len(COUNTED) // 16)]


def _differ(kind: str) -> Column:
    """Bits in which two lines' signatures of one kind differ."""
    return sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SIGNED if c[0] == kind), F.lit(0))


def _alike(edits: int) -> Column:
    """Whether lengths and signatures allow that two lines are near: an edit makes, drops or changes at most three words, and the counts of at most two characters by one."""
    most = _allowed(F.least("size_a", "size_b"), edits)
    return (F.abs(F.col("size_a") - F.col("size_b")) <= most) & (_differ("n") <= 2 * most) & (_differ("g") <= PER_CHANGE * most)


def _verified(pairs: DataFrame, edits: int) -> DataFrame:
    """``first`` of the later lines of the pairs that are near.

    Spark moves this filter into the join that makes the pairs and evaluates it before
    the join's own conditions, so ``likely``, which holds them, guards the edit distance.
    """
    most = _allowed(F.least(F.length("line_a"), F.length("line_b")), edits)
    near = pairs.filter(F.when(F.col("likely"), (F.col("line_a") != F.col("line_b")) & _within("line_a", "line_b", most, edits)).otherwise(False))
    return near.select(F.greatest("a", "b").alias("first")).distinct()


def near_lines_within(lines: DataFrame, edits: int) -> DataFrame:
    """``first`` of the distinct lines that are near a line that comes earlier, within up to ``edits`` edits.

    Keys are counted first, with the unshifted ones in the upper half of the count;
    only rows whose key is marked as shared are then joined.
    """
    keyed = shifted_keys(lines, edits)
    counted = keyed.groupBy("key").agg(F.sum(F.when(F.col("own"), F.lit((1 << 32) + 1)).otherwise(F.lit(1))).alias("c"))
    shared = settle(counted.select(F.col("key").alias("k"), F.col("c").bitwiseAND(F.lit((1 << 32) - 1)).alias("members"), (F.shiftright("c", 32) > 0).alias("any")).filter("members > 1 and any").select("k", "members"))
    rows = marked(keyed, shared, "k", "key").filter("__marked").join(shared, F.col("key") == F.col("k"))
    rows = rows.groupBy("key", "members", F.col("h1").alias("x1")).agg(F.max("own").alias("own"))
    rows = settle(rows)
    touched = lines.join(rows.select(F.col("x1").alias("y1")).distinct(), F.col("h1") == F.col("y1"), "left_semi")
    signed = touched.select("h1", "first", "line", F.length("line").alias("size"), *_counts(F.col("line")), F.explode(F.array(_signature(F.col("line")))).alias("g"))
    signed = settle(signed.select("h1", "first", "line", "size", *(F.col("g")[p].alias(f"g{p}") for p in range(PARTS)), *(c for c in SIGNED if c[0] == "n")), dense=True)
    # A line goes along with its keys of small and of large buckets, so a pair that shares several is judged in the bucket of the least one.
    few = F.col("members") <= SMALL
    keys = [F.sort_array(F.collect_list(F.when(of & which, F.col("key")))).alias(c) for c, of, which in (("all_few", few, F.lit(True)), ("owned_few", few, F.col("own")), ("all_many", ~few, F.lit(True)), ("owned_many", ~few, F.col("own")))]
    signed = signed.join(rows.groupBy(F.col("x1").alias("y1")).agg(*keys), F.col("h1") == F.col("y1")).drop("y1")
    rows = settle(rows.join(signed, F.col("x1") == F.col("h1")).select("key", "members", "first", "line", "size", *(F.when(few, F.col(f"{c}_few")).otherwise(F.col(f"{c}_many")).alias(c) for c in ("all", "owned")), *SIGNED), dense=True)
    names = ["first", "line", "size", "all", "owned", *SIGNED]

    def sides(x: DataFrame, y: DataFrame, *more: str, once: bool = True) -> DataFrame:
        a = x.select(F.col("key").alias("k"), *(F.col(c).alias(f"{c}_a") for c in [*names, *more]))
        b = y.select(F.col("key").alias("k2"), *(F.col(c).alias(f"{c}_b") for c in [*names, *more]))
        least = F.least(*(F.array_min(F.array_intersect(f"{c}_a", f"{d}_b")) for c, d in (("all", "owned"), ("owned", "all"))))
        own = F.array_contains("owned_a", F.col("k")) | F.array_contains("owned_b", F.col("k"))
        likely = (F.col("first_a") < F.col("first_b")) & _alike(edits) & (F.col("k") == least if once else own)
        met = F.col("k") == F.col("k2")
        for c in more:
            met = met & (F.col(f"{c}_a") == F.col(f"{c}_b"))
        return a.join(b, met & likely).select(F.col("first_a").alias("a"), "line_a", F.col("first_b").alias("b"), "line_b", likely.alias("likely"))

    small = rows.filter(F.col("members") <= SMALL)
    large = rows.filter(F.col("members") > SMALL)
    tops = large.groupBy("key").agg(F.min(F.struct(*names)).alias("top")).select("key", "top.*")
    near = settle(_verified(sides(small, small).union(sides(tops, large, once=False)), edits))
    left = large.join(near.withColumnRenamed("first", "z"), F.col("first") == F.col("z"), "left_anti")
    # Lengths in blocks: a line of ``left`` stands in each that holds a length within the edits of its own, at most two.
    block = lambda n: F.floor(n / (2 * edits))
    left = left.withColumn("block", F.explode(F.array_distinct(F.array(block(F.col("size") - edits), block(F.col("size") + edits)))))
    return near.union(_verified(sides(large.withColumn("block", block(F.col("size"))), left, "block"), edits)).distinct()


def removals(docs: DataFrame, edits: int = EDIT) -> DataFrame:
    """__id, __h, __exact and __near: the places of the lines to remove, by reason, of documents that lose lines."""
    lines = settle(distinct_lines(docs, edits), dense=True)
    near = settle(near_lines(docs, lines) if edits == 1 else near_lines_within(lines, edits)).select(F.col("first").alias("z"), F.lit(True).alias("near"))
    judged = lines.join(near, F.col("first") == F.col("z"), "left").select("h1", "h2", "first", "copies", F.coalesce("near", F.lit(False)).alias("near")).filter("copies > 1 or near")
    judged = settle(judged)
    seen = _lines(docs).select(F.xxhash64("line").alias("x1"), F.xxhash64(F.lit(1), "line").alias("x2"), "doc_id", "pos", "h")
    seen = marked(seen, judged, "h1", "x1").filter("__marked").drop("__marked")
    hit = seen.join(judged, (F.col("x1") == F.col("h1")) & (F.col("x2") == F.col("h2"))).withColumn("later", F.struct("doc_id", "pos", "h") != F.col("first")).filter("near or later")
    return hit.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_set(F.when(F.col("later"), F.col("pos"))).alias("__exact"), F.collect_set(F.when(~F.col("later"), F.col("pos"))).alias("__near"))


def _applied(docs: DataFrame, edits: int) -> DataFrame:
    """``docs`` with __exact and __near; rows that surely lose nothing stay where they are read."""
    gone = settle(removals(docs, edits))
    none = F.array().cast("array<int>")
    rows = marked(docs.withColumn("__own", F.xxhash64("text")), gone, "__h", "__own")
    sure = rows.filter(~F.col("__marked")).select(*docs.columns, none.alias("__exact"), none.alias("__near"))
    doubt = rows.filter("__marked").join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__h")), "left")
    return sure.unionByName(doubt.select(*docs.columns, F.coalesce("__exact", none).alias("__exact"), F.coalesce("__near", none).alias("__near")))


def _left() -> Column:
    """The text without the removed lines."""
    drop = F.concat("__exact", "__near")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(drop, i))
    return F.when(F.size(drop) > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))


def clean(docs: DataFrame, edits: int = EDIT) -> DataFrame:
    """The documents without the removed lines; all other columns as they are."""
    return _applied(docs, edits).withColumn("text", _left()).select(*docs.columns)


def report(docs: DataFrame, edits: int = EDIT) -> DataFrame:
    """One row per document: doc_id, n_lines, n_exact, n_near (lines removed) and text, what is left."""
    rows = _applied(docs.select("doc_id", "text"), edits)
    n = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    return rows.select("doc_id", n.cast("long").alias("n_lines"), F.size("__exact").cast("long").alias("n_exact"), F.size("__near").cast("long").alias("n_near"), _left().alias("text"))

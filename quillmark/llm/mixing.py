"""Mixing sources to target weights by hash order, prefix sums and exact cuts.

Every document gets a hash-random key, the MD5 of its id.  Documents of a source
stand in the order of their keys; running sums of sizes over that order come in
three levels, over the first two bytes of the key and then within them, so no
task holds a source.  A source's budget, its target rounded down, then cuts the
order exactly: epochs that fit are taken whole, and the document at the cut in
part.

Targets: the sources' weights share the total size; a source may take at most
``epochs`` times its size, and what it leaves is shared again by weight until no
source is above its bound.

Defined results: a null text has size 0; sources order by code points with null
last, as one source; repeated rows are documents of their own, ordered by size
and then taken as equals; an empty table gives an empty result; other columns are
kept by ``mix`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

#: Times that a document may be taken.
EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to which their cuts are broadcast; beyond it, they are joined by shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key() -> Column:
    """The hash that orders a source's documents."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def targets(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target from source, source_size; the n-th source weighs 1, 2, 3, 1, ...

    In the order of source_size / weight, the sources that reach their bound are
    the first ones; the share of the rest follows from sums over that order.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(everything) - 1) % 3 + 1).cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy())
    weights = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (total - epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / weights
    full = F.col("level") * F.col("weight") >= epochs * F.col("source_size")
    ranked = weighed.withColumn("level", level).withColumn("full", full)
    rest = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(Window.partitionBy())
    open_level = rest["level"]
    return ranked.select("source", "source_size", F.when(F.col("full") | open_level.isNull(), F.lit(float(epochs)) * F.col("source_size")).otherwise(open_level * F.col("weight")).alias("target"))


def plan(docs: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    rows = settle(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), _key().alias("key")))
    rows = rows.withColumn("b1", F.substring("key", 1, 2)).withColumn("b2", F.substring("key", 3, 2))
    fine = settle(rows.groupBy("source", "b1", "b2").agg(F.sum("size").alias("part")))
    coarse = fine.groupBy("source", "b1").agg(F.sum("part").alias("part"))
    goals = targets(coarse.groupBy("source").agg(F.sum("part").alias("source_size")), epochs)
    running = lambda by, order: F.coalesce(F.sum("part").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = coarse.select(F.col("source").alias("s1"), F.col("b1").alias("k1"), running(["source"], "b1").alias("from1"))
    fine = fine.select("source", "b1", "b2", running(["source", "b1"], "b2").alias("from2"))
    starts = fine.join(coarse, fine["source"].eqNullSafe(coarse["s1"]) & (fine["b1"] == coarse["k1"])).select(F.col("source").alias("s2"), F.col("b1").alias("k1"), F.col("b2").alias("k2"), (F.col("from1") + F.col("from2")).alias("start"))
    own = Window.partitionBy("source", "b1", "b2").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
    rows = rows.join(starts, rows["source"].eqNullSafe(starts["s2"]) & (rows["b1"] == starts["k1"]) & (rows["b2"] == starts["k2"]))
    goals = goals.withColumnRenamed("source", "s3")
    rows = rows.drop("k1").join(goals, rows["source"].eqNullSafe(goals["s3"]))
    first = F.floor(F.col("target")) - F.col("start") - F.col("inside")
    taken = sum((F.least(F.greatest(first - e * F.col("source_size"), F.lit(0)), F.col("size")) for e in range(epochs)), F.lit(0).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def cuts(docs: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Per source: whole, how often all of it is taken, and cut (key, id, size, extra).

    Rows that come before the cut are taken once more, rows that equal it share
    ``extra`` words.  A source that is only taken as a whole has no cut.
    """
    rows = plan(docs, epochs)
    whole = F.floor(F.floor("target") / F.greatest("source_size", F.lit(1))).cast("int")
    rows = rows.withColumn("whole", whole).withColumn("extra", F.col("taken") - F.col("whole") * F.col("size"))
    place = F.when(F.col("extra") > 0, F.struct(_key().alias("key"), F.col("doc_id").alias("id"), F.col("size").alias("size")))
    places = rows.groupBy("source", "whole", place.alias("place")).agg(F.sum("extra").alias("extra"))
    last = F.max(F.when(F.col("place").isNotNull(), F.struct("place", "extra")))
    return places.groupBy("source", "whole").agg(last.alias("last")).select(F.col("source").alias("__s"), F.col("whole").alias("__whole"), F.col("last.place").alias("__cut"), F.col("last.extra").alias("__extra"))


def mix(docs: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """The mixed documents: each as often as it is taken, the one at a source's cut in part.

    The part holds the first words of the text, with one space between them.
    Documents without words take no part.  Every row is compared with its source's
    cut where it is read, so texts do not move; only rows that equal the cut, which
    are repeated rows of one document, are numbered to share out what is left.
    """
    goals = settle(cuts(docs, epochs))
    if goals.count() <= BROADCAST_SOURCES:
        goals = F.broadcast(goals)
    rows = docs.withColumns({"__key": _key(), "__size": word_count(F.col("text"))})
    rows = rows.join(goals, F.col("source").cast("string").eqNullSafe(F.col("__s")))
    place = F.struct("__key", F.col("doc_id"), F.col("__size"))
    at_cut = F.coalesce((F.col("__key") == F.col("__cut.key")) & (place == F.col("__cut")), F.lit(False))
    once_more = F.coalesce(place < F.col("__cut"), F.lit(False))
    apart = rows.filter(~at_cut).withColumn("__more", F.when(once_more, F.col("__size")).otherwise(F.lit(0)))
    number = F.row_number().over(Window.partitionBy("__s", "__key", "doc_id", "__size").orderBy(F.xxhash64("text")))
    equal = rows.filter(at_cut).withColumn("__more", F.least(F.greatest(F.col("__extra") - (number - 1) * F.col("__size"), F.lit(0)), F.col("__size")))
    chosen = apart.unionByName(equal).filter("__size > 0 and __whole + __more > 0")
    part = F.when(F.col("__more") < F.col("__size"), F.col("__more")).otherwise(F.lit(0)).cast("int")
    times = F.col("__whole") + F.when(F.col("__more") == F.col("__size"), 1).otherwise(0)
    first_words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, part), " ")
    copies = F.concat(F.array_repeat("text", times), F.when(part > 0, F.array(first_words)).otherwise(F.array().cast("array<string>")))
    rest = [c for c in docs.columns if c != "text"]
    return chosen.select(*rest, F.explode(copies).alias("text")).select(*docs.columns)

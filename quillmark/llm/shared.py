"""What several operators share: settled tables and file places."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits for each marked key, and most bits of a bitmap of marks; it is broadcast, so of bounded size.
BITS_EACH, MARK_BITS = 32, 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that the driver and all executors see.

    Only where the session has none, as in tests on one machine, a temporary
    folder takes its place.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = context._jsc.sc().getCheckpointDir()
        path = path.get() if path.isDefined() else "file://" + tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def settle(df: DataFrame, dense: bool = False) -> DataFrame:
    """The rows of ``df``, computed once and kept as Parquet in the shared folder.

    It cuts the lineage: what follows reads files that outlive any executor.
    ``dense`` packs texts more tightly, for more CPU.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd" if dense else None)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives back what a worker holds between tasks: mapped arrays, tables of powers, freed memory.

    Workers are reused, so what one task leaves behind would count against all later ones.
    """
    from . import store, textcore

    store.forget()
    textcore.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library, which has no such call


def released(run: Callable) -> Callable:
    """The Arrow function ``run``, followed by ``release`` when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def marked(rows: DataFrame, keys: DataFrame, key: str, column: str = "doc_id") -> DataFrame:
    """``rows`` with __marked: true for all whose ``column`` is among the values of ``keys.key``, and for few others.

    A bitmap of hashed values, of bounded size and so broadcast, tells rows apart
    where they are read.  Where keys are so many that it fills up, more rows are
    marked.  Rows without a value are not marked.
    """
    bits = min(max(1 << (BITS_EACH * max(1, keys.count()) - 1).bit_length(), 1 << 16), MARK_BITS)
    bit = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    marks = keys.groupBy(F.bitmap_bucket_number(bit(key)).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit(key))).alias("__bits"))
    found = rows.withColumn("__bit", F.when(F.col(column).isNotNull(), bit(column)))
    found = found.join(F.broadcast(marks), F.bitmap_bucket_number("__bit") == F.col("__bucket"), "left")
    place = F.bitmap_bit_position("__bit")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (place % 8).cast("int") + 1)) != 0, F.lit(False))
    return found.select(*(f"`{c}`" for c in rows.columns), on.alias("__marked"))


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def parts(df: DataFrame, size: int, least: int = 8, most: int = 1 << 24) -> int:
    """Parts of about ``size`` bytes for the input files of ``df``, as its plan knows them.

    Where the plan knows no size, there are two parts for each partition.  ``most``
    bounds what is listed by part on the driver; 16 million parts of 6 MB are 100 TB.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if total >= 1 << 60:
        return int(min(max(least, 2 * df.rdd.getNumPartitions()), most))
    return int(min(max(least, total // size), most))

"""Shared folder, lineage cuts and a bounded prefilter for the operators of this folder."""
from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from `spark.checkpoint.dir`; a temporary one only in local mode, where driver and tasks share the machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="run-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def pin(df: DataFrame, name: str = "pin") -> DataFrame:
    """Write a table into the shared folder and read it again: it survives lost executors and is computed once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_bytes(spark: SparkSession, most: int = 4 << 20):
    """Arrow batches of at most `most` bytes (or one longer row) for what is run inside; by default a batch has 10,000 rows and up to 64 MB.
    The session's setting comes back behind it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release_memory() -> None:
    """Gives memory that Arrow and the C library hold without using it back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def releasing(run):
    """A function over Arrow batches whose worker keeps no freed memory behind the end of its task: a worker is used again, and its executor shares one limit with it."""
    @wraps(run)
    def whole(batches):
        yield from run(batches)
        release_memory()

    return whole


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores behind it where df has a column of that name."""
    while name in df.columns:
        name += "_"
    return name


def row_name(key: str, text: str) -> Column:
    """A row's key and a hash of its text: what decisions on rows are carried by, as keys may be null or repeat."""
    return F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull().cast("string"), F.xxhash64(text).cast("string"))


def without_rows(df: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """df without the rows whose `name` is in `gone`, which is written first.

    A Bloom filter of 4 MB tells the rows that are surely not listed, which stay where they are; only the others meet the list,
    so a list too long for a broadcast does not shuffle the whole table.
    """
    listed = pin(gone.select(name).distinct(), "gone")
    found = bloom_words(listed, name, bits=1 << 25)

    @F.arrow_udf("boolean")
    def may_go(h: pa.Array) -> pa.Array:
        return pa.array(bloom_hit(h.to_numpy(), found))

    hit = may_go(F.xxhash64(name))
    return df.filter(~hit).unionByName(df.filter(hit).join(listed, name, "left_anti").select(*df.columns))


def with_global_rank(df: DataFrame, order: list[str], out: str = "rank") -> tuple[DataFrame, int]:
    """(df with a gapless 0-based rank in the total order `order`, number of rows).

    Rows are range-partitioned and sorted by `order`, which must be unique per row, and
    pinned by a checkpoint, so that the position in a partition is fixed; only the counts per
    partition go through the driver. Pass narrow rows.
    """
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["n"]) for r in laid.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = {}, 0
    for p, n in counts:
        before[p], total = total, total + n
    if not before:
        return laid.withColumn(out, F.col("_at")).drop("_at"), 0
    first = [before.get(p, 0) for p in range(max(before) + 1)]
    base = F.get(F.from_json(F.lit(str(first)), "array<bigint>"), part.cast("int"))
    return laid.withColumn(out, base + row).drop("_at"), total


def bloom_words(keys: DataFrame, key: str, bits: int = 1 << 23, hashed: bool = True) -> np.ndarray:
    """Bloom filter of a column as 64-bit words, two bits per key.

    `bits` is fixed, so the filter is 1 MB whatever the number of keys; a filter that fills up
    only lets more rows through to the exact join behind it. A column that is a hash already is
    taken as it is (hashed=False).
    """
    h = F.xxhash64(key) if hashed else F.col(key)
    spots = F.explode(F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 32), F.lit(bits))))
    rows = (keys.select(spots.alias("b")).groupBy(F.shiftright("b", 6).alias("w"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b").bitwiseAND(63).cast("int"))).alias("v")).toArrow())
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["v"].to_numpy()
    return out


def bloom_hit(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether hashes (xxhash64 of the key, or the key itself) may be in the filter; false only for absent keys."""
    bits, table = len(words) * 64, words.view(np.uint64)

    def hit(spot):
        return (table[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1

    return hit(h % bits) & hit((h >> 32) % bits)

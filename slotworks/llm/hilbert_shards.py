"""Sharding along a Hilbert curve over several quantised metadata dimensions.

Each dimension becomes a code of `bits` bits from its own value alone: numbers by the length of
their binary form (so a code stands for a factor of two), other types by CRC-32. Rows are ordered
by curve index and key, and cut into runs whose row counts differ by one at most. A run is a
compact region in all dimensions at once; `manifest` keeps its code ranges, and `prune` the shards
that can hold given values.

Edge cases: a null value has code 0; a null text has no bytes; null keys come first within a cell;
rows that repeat everything take neighbouring slots; with fewer rows than shards some shards are
empty; an empty table gives an empty result. Columns of df other than those named are dropped.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_global_rank


def curve_table(n: int) -> list[int]:
    """Steps of the n-dimensional curve: at state * 2**n + cell stands next state * 2**n + digit.

    A state is an entry corner and a main direction, as direction * 2**n + corner.
    """
    size, mask = 1 << n, (1 << n) - 1

    def left(x: int, by: int) -> int:
        by %= n
        return ((x << by) | (x >> (n - by))) & mask

    def gray(x: int) -> int:
        return x ^ (x >> 1)

    place = {gray(w): w for w in range(size)}
    out = []
    for direction in range(n):
        for corner in range(size):
            for cell in range(size):
                w = place[left(cell ^ corner, n - (direction + 1) % n)]
                entry = 0 if w == 0 else gray(2 * ((w - 1) // 2))
                ones = w if w % 2 else w - 1  # the run of low ones of this number is the direction moved in
                turn = 0 if w == 0 else ((ones ^ (ones + 1)).bit_length() - 1) % n
                to = (direction + turn + 1) % n * size + (corner ^ left(entry, direction + 1))
                out.append(to * size + w)
    return out


def code(df: DataFrame, name: str, bits: int) -> Column:
    """A dimension's code of `bits` bits."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.NumericType):
        whole = c.cast("bigint")
        return F.when(whole > 0, F.least(F.length(F.bin(whole)), F.lit((1 << bits) - 1))).otherwise(0).cast("bigint")
    return F.coalesce(F.pmod(F.crc32(c.cast("string")), F.lit(1 << bits)), F.lit(0)).cast("bigint")


def curve_index(codes: list[str], bits: int) -> Column:
    """Position on the curve of a cell given by its code columns, the highest bits first."""
    n = len(codes)
    table, size = curve_table(n), 1 << n
    width = (n * size - 1).bit_length()
    steps = F.array(*[F.lit(x) for x in table])

    def step(acc: Column, i: Column) -> Column:
        cell = reduce(lambda a, b: a * 2 + b, [F.call_function("shiftright", F.col(c), F.lit(bits - 1) - i).bitwiseAND(1) for c in codes])
        found = F.get(steps, (acc.bitwiseAND((1 << width) - 1) * size + cell).cast("int"))
        digits = F.shiftright(acc, width) * size + found % size
        return digits * (1 << width) + F.shiftright(found, n)

    return F.shiftright(F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("bigint"), step), width)


def assign(df: DataFrame, shards: int, dimensions: list[str], key: str = "doc_id", text: str = "text", bits: int = 5) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard, curve, one code per dimension): a row per row of df.

    size: UTF-8 bytes of the text plus 16. slot: gapless position in the shard. The law is `rows`.
    """
    codes = [f"code_{d}" for d in dimensions]
    narrow = df.select(F.col(key).alias("_key"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint").alias("size"),
                       F.coalesce(F.crc32(text), F.lit(0)).cast("bigint").alias("text_crc32"), *[code(df, d, bits).alias(c) for d, c in zip(dimensions, codes)])
    ranked, total = with_global_rank(narrow.withColumn("curve", curve_index(codes, bits)), ["curve", "_key"])
    total = max(total, 1)
    shard = F.expr(f"(rank * {shards}L) div {total}L").cast("int")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return (ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - first)
            .select(F.col("_key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", *codes))


def manifest(assigned: DataFrame) -> DataFrame:
    """(shard, rows, bytes, and lowest and highest code of each dimension)."""
    codes = [c for c in assigned.columns if c.startswith("code_")]
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *[f(c).alias(f"{side}_{c}") for c in codes for side, f in (("low", F.min), ("high", F.max))])


def prune(shards: DataFrame, df: DataFrame, values: dict, bits: int = 5) -> DataFrame:
    """Rows of a manifest whose shards can hold all of the given values of dimensions of df."""
    for name, value in values.items():
        one = df.sparkSession.createDataFrame([(value,)], T.StructType([df.schema[name]])).select(code(df, name, bits).alias("c")).first()["c"]
        shards = shards.filter((F.col(f"low_code_{name}") <= one) & (F.col(f"high_code_{name}") >= one))
    return shards

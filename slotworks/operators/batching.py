"""Deterministic epoch batches and step statistics."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ordering import HOT_ROWS, bucket_bits, with_hash_ordinal, with_row_number


def epoch_batches(ids: DataFrame, key: str, seed: int, epoch: int, batch: int, accum: int, start_group: int = 0) -> DataFrame:
    """(key, ordinal, batch, group): a permutation fixed by (seed, epoch), without the
    incomplete last group, from `start_group` on."""
    hashed = ids.select(key).withColumn("_h", S.hash_bits(F.lit(seed), F.lit(epoch), key))
    total = ids.count()
    numbered = with_hash_ordinal(hashed, "_h", [key], "ordinal", bucket_bits(total))
    group = batch * accum
    kept = total // group * group
    return (numbered.filter((F.col("ordinal") < kept) & (F.col("ordinal") >= start_group * group))
            .select(key, "ordinal", F.floor(F.col("ordinal") / batch).alias("batch"), F.floor(F.col("ordinal") / group).alias("group")))


def epoch_union_coverage(ids: DataFrame, key: str, seed: int, epochs: int, batch: int, accum: int) -> DataFrame:
    """One row: ids seen in at least one epoch, all ids, and the dropped per epoch."""
    runs = [epoch_batches(ids, key, seed, e, batch, accum).select(key) for e in range(epochs)]
    seen = reduce(DataFrame.unionByName, runs).groupBy(key).agg(F.lit(1).alias("_seen"))
    both = ids.select(key).join(seen, key, "left")
    return both.agg(F.count("_seen").alias("seen"), F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) % (batch * accum)).alias("dropped_per_epoch"))


def rolling_median(steps: DataFrame, run: str, order: str, value: str, width: int = 8, floor: float = 60.0,
                   hot_rows: int = HOT_ROWS, chunk: int = 65_536) -> DataFrame:
    """Median of the last `width` durations, and reserve = max(floor, 2 * median).

    Ordinals are cut into chunks that overlap by width - 1 rows, so one long run
    is spread over many window partitions.
    """
    numbered = with_row_number(steps, [run], [F.col(order).asc()], "_o", hot_rows).withColumn("_o", F.col("_o") - 1)
    home = F.floor(F.col("_o") / chunk)
    ends = F.floor((F.col("_o") + (width - 1)) / chunk)
    spread = numbered.withColumn("_home", home).withColumn("_chunk", F.explode(F.sequence(home, ends)))
    window = Window.partitionBy(run, "_chunk").orderBy("_o").rowsBetween(-(width - 1), 0)
    out = spread.withColumn("median", F.percentile(F.col(value), S.dbl(0.5)).over(window)).filter(F.col("_home") == F.col("_chunk"))
    return out.withColumn("reserve", F.greatest(S.dbl(floor), S.dbl(2) * F.col("median"))).drop("_home", "_chunk", "_o")

"""Ranks, ordinals, running sums and quantiles that survive a hot key.

A plain ordered window puts a whole group into one task. Two ways around that:

* `running_totals` first collapses equal values (map-side combined), then cuts
  the value axis at quantiles of the distinct values, prefixes the totals of
  these ranges and only orders values inside one range. The cuts are constants of
  the plan, so the range of a value is a pure function of the value and a retried
  task can never disagree with its siblings.
* `with_row_number` measures the largest group. Up to `hot_rows` rows a window
  is the right plan; beyond it rows are range-partitioned by (keys, order), the
  assignment is checkpointed, and each range is numbered on its own.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col, dbl
from ..session import pin, stored

HOT_ROWS = 2_000_000


def with_row_number(df: DataFrame, keys: list[str], order: list[Column], out: str = "rn",
                    hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """1-based position of each row inside its group under a total order.

    hot_rows=None is the caller's word that groups are small: no size check.
    """
    window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    if hot_rows is None:
        return df.withColumn(out, F.row_number().over(window).cast("bigint"))
    sizes = df.groupBy(*keys).count() if keys else df.groupBy().count()
    largest, total = sizes.agg(F.max("count"), F.sum("count")).first()
    if (largest or 0) <= hot_rows:
        return df.withColumn(out, F.row_number().over(window).cast("bigint"))

    parts = max(8, 2 * -(-total // hot_rows))
    ranged = df.repartitionByRange(parts, *[F.col(k).asc() for k in keys], *order)
    ranged = pin(ranged.withColumn("_range", F.spark_partition_id()))
    group = [*keys, "_range"]
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (ranged.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
              .select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)],
                      F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")))
    inside = ranged.withColumn("_in", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return (inside.join(before, same(group))
            .withColumn(out, (F.col("_before") + F.col("_in")).cast("bigint")).select(*df.columns, out))


def with_previous(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """`value` of the preceding row of the group (NULL for the first).

    Neighbours meet through an equi-join on (keys, ordinal), which spreads a hot
    group over all tasks.
    """
    numbered = with_row_number(df, keys, order, "_ord", hot_rows)
    ahead = numbered.select(*keys, (F.col("_ord") + 1).alias("_ord"), F.col(value).alias(out))
    return numbered.join(ahead, [*keys, "_ord"], "left").drop("_ord")


def bucket_bits(rows: int, per_bucket: int = 100_000) -> int:
    """Leading hash bits that keep buckets near `per_bucket` rows."""
    return max(4, min(22, (max(1, rows) // per_bucket).bit_length() + 1))


def with_hash_ordinal(df: DataFrame, hash_col: str, tie: list[str], out: str = "ordinal", bits: int = 12,
                      keys: list[str] = ()) -> DataFrame:
    """0-based ordinal in the order of a 32-bit hash (ties by `tie`).

    Hash bits are uniform, so their leading bits cut the table into even buckets
    without a look at the data; `bucket_bits` gives `bits` for a row count.
    """
    keys = list(keys)
    cut = df.withColumn("_b", F.shiftright(F.col(hash_col), 32 - bits))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = (cut.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_rows"))
              .select(*keys, "_b", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")))
    inside = Window.partitionBy(*keys, "_b").orderBy(hash_col, *tie)
    return (cut.withColumn("_in", F.row_number().over(inside)).join(before, [*keys, "_b"])
            .withColumn(out, (F.col("_before") + F.col("_in") - 1).cast("bigint")).drop("_b", "_in", "_before"))


RANGE_ROWS = 250_000


def range_cuts(df: DataFrame, value: str, rows: int = RANGE_ROWS) -> list[float]:
    """Ascending cuts that deal the rows of a stored table into ranges of about `rows` rows, 4096 ranges at the most."""
    n = min(4096, -(-df.count() // rows))
    if n < 2:
        return []
    return df.agg(F.percentile_approx(F.col(value).cast("double"), [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0]


def value_range(value: str, cuts: list[float]) -> Column:
    """Number of the cuts that are not above the value: coarse cuts first, then those between two of them."""
    if not cuts:
        return F.lit(0)
    step = int(len(cuts) ** 0.5) + 1
    x, every = F.col(value).cast("double"), F.array(*[F.lit(c) for c in cuts])
    below = lambda c: F.size(F.filter(c, lambda v: v <= x))
    coarse = below(F.array(*[F.lit(c) for c in cuts[step - 1::step]])) * step
    return coarse + below(F.slice(every, coarse + 1, step))


def no_nan(df: DataFrame, value: str) -> DataFrame:
    if df.schema[value].dataType.typeName() not in ("double", "float"):
        return df
    return df.withColumn(value, F.when(F.isnan(value), F.raise_error(F.lit(f"NaN in {value}"))).otherwise(F.col(value)))


def running_totals(df: DataFrame, by: list[str], value: str, measures: dict[str, Column]) -> DataFrame:
    """One row per (by, value): each measure m at the value, `m_below` strictly
    below it, and `m_all` over the whole group. NULL values are left out, NaN is an
    error, and NULL in `by` is a group like any other.

    Distinct values are stored once and cut into ranges. A range's total of everything
    below it goes in front of its rows as a row without a value, so the cells of a
    range are shuffled once more and joined with nothing.
    """
    names = list(measures)
    cells = stored(no_nan(df, value).filter(F.col(value).isNotNull()).groupBy(*by, value)
                   .agg(*[F.sum(measures[m]).alias(m) for m in names]), "cells")
    cells = cells.withColumn("_range_no", value_range(value, range_cuts(cells, value)))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    earlier = group.orderBy("_range_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = cells.groupBy(*by, "_range_no").agg(*[F.sum(m).alias(f"_{m}_t") for m in names])
    nothing = F.lit(None)
    front = totals.select(*by, nothing.cast(cells.schema[value].dataType).alias(value), "_range_no",
                          *[F.coalesce(F.sum(f"_{m}_t").over(earlier), F.lit(0)).cast(cells.schema[m].dataType).alias(m) for m in names],
                          *[F.sum(f"_{m}_t").over(group).cast(cells.schema[m].dataType).alias(f"{m}_all") for m in names])
    both = front.unionByName(cells.select(*by, value, "_range_no", *names, *[nothing.cast(cells.schema[m].dataType).alias(f"{m}_all") for m in names]))
    inside = Window.partitionBy(*by, "_range_no").orderBy(F.col(value).asc_nulls_first())
    below = inside.rowsBetween(Window.unboundedPreceding, -1)
    summed = both.select(*by, value, *names, *[F.sum(m).over(below).alias(f"{m}_below") for m in names],
                         *[F.first(f"{m}_all").over(below).alias(f"{m}_all") for m in names])
    return summed.filter(F.col(value).isNotNull())


def same(columns: list[str]) -> Column:
    """Null-safe equality of columns with `_k0`, `_k1`, ..."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(columns)])


def with_average_rank(df: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """Rank with ties averaged (1-based); `out`_n is the group's count of values. Rows
    without a value stay, with a NULL rank."""
    totals = running_totals(df, by, value, {"_c": F.lit(1).cast("bigint")})
    ranks = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, value])], (F.col("_c_below") + (F.col("_c") + 1) / dbl(2)).alias(out),
                          F.col("_c_all").alias(f"{out}_n"))
    return df.join(ranks, same([*by, value]), "left").select(*df.columns, out, f"{out}_n")


def exact_quantiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles, one column each, plus n_values.

    Exact like percentile(), but no group's values ever meet in one task.
    """
    totals = running_totals(df, by, value, {"_c": F.lit(1).cast("bigint")})
    first, last = F.col("_c_below"), F.col("_c_below") + F.col("_c") - 1
    aggs = []
    for name, q in quantiles.items():
        at = (F.col("_c_all") - 1) * dbl(q)
        for part, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((pos >= first) & (pos <= last), F.col(value))).cast("double").alias(f"_{name}_{part}"))
    found = totals.groupBy(*by).agg(F.max("_c_all").alias("n_values"), *aggs)
    out = []
    for name, q in quantiles.items():
        at = (F.col("n_values") - 1) * dbl(q)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return found.select(*by, *out, "n_values")

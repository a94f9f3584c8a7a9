"""Study -> series -> slices selection: slots, candidates, indices, plans."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.geometry import PLANES, slice_indices
from .checks import coverage_report, rule_table
from .ordering import HOT_ROWS, with_row_number

SLOTS = 6


def with_slot(df: DataFrame, planes: list[str] = PLANES, plane: str = "plane", fat_sup: str = "fat_sup") -> DataFrame:
    """slot = plane index + planes * (1 - fat_sup); NULL for unknown values."""
    at = F.array_position(F.array(*[F.lit(p) for p in planes]), F.col(plane)) - 1
    fs = F.col(fat_sup).cast("int")
    ok = (at >= 0) & fs.isin(0, 1)
    return df.withColumn("slot", F.when(ok, at + len(planes) * (1 - fs)).cast("int"))


def expect_slots(slotted: DataFrame, key: str = "series_id") -> DataFrame:
    return rule_table(slotted, key, {"unknown_plane_or_flag": F.col("slot").isNull()})


def usable_series(df: DataFrame, n: str = "n", minimum: int = 3) -> DataFrame:
    return df.filter(F.col(n) >= minimum)


def expect_cached_series(df: DataFrame, key: str = "series_id", cap: int = 64) -> DataFrame:
    n, raw = F.col("n"), F.col("n_raw")
    return rule_table(df, key, {"n_range": ~F.coalesce(n.between(3, cap), F.lit(False)),
                                "n_raw": ~F.coalesce(raw > 0, F.lit(False))})


def lookup_count(df: DataFrame, counts: DataFrame, key: str = "series_id", n: str = "n", default: int = 0) -> DataFrame:
    """Missing series count as `default`. Spark broadcasts a small side itself."""
    return df.join(counts.select(key, n), key, "left").withColumn(n, F.coalesce(F.col(n), F.lit(default)))


def rank_candidates(series: DataFrame, ordinal: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rank inside (study, slot): deepest first, then series id; with `ordinal`
    the legacy rule keeps input order among equals."""
    tie = F.col(ordinal) if ordinal else F.col("series_id")
    return with_row_number(series, ["study_id", "slot"], [F.col("n").desc(), tie.asc()], "rank", hot_rows)


def select_series(series: DataFrame, carry: list[str] = ("n",)) -> DataFrame:
    """First candidate per (study, slot) as one map-side-combined aggregate; no sort,
    no ranking, no hot task."""
    best = F.min(F.struct((-F.col("n")).alias("_deep"), F.col("series_id"), *[c for c in carry])).alias("_b")
    return series.groupBy("study_id", "slot").agg(best).select("study_id", "slot", "_b.series_id", *[f"_b.{c}" for c in carry])


def expect_every_study(spine: DataFrame, selected: DataFrame) -> DataFrame:
    """A study without any slot is an error row ('missing')."""
    return coverage_report(spine.select("study_id").distinct(), selected.select("study_id").distinct(), ["study_id"])


def sample_candidate(series: DataFrame, seed: int, epoch: int, carry: list[str] = ("n",)) -> DataFrame:
    """One uniformly drawn candidate per slot, fixed by (seed, epoch, study, slot).

    The candidate of smallest hash wins: one aggregate combined map-side, with no
    ranking and no candidate count, and the same under any partitioning.
    """
    draw = S.hash_bits(F.lit(seed), F.lit(epoch), "study_id", "slot", "series_id")
    best = F.min(F.struct(draw.alias("_draw"), F.col("series_id"), *carry)).alias("_b")
    return series.groupBy("study_id", "slot").agg(best).select("study_id", "slot", "_b.series_id", *[f"_b.{c}" for c in carry])


def with_indices(selected: DataFrame, k: int = 4) -> DataFrame:
    return selected.withColumn("idx", slice_indices("n", k))


def plan_rows(selected: DataFrame, k: int = 4) -> DataFrame:
    """(study, slot, k, slice_no, position, series, shard): the full global plan."""
    rows = with_indices(selected, k).select("study_id", "slot", "series_id", "shard", "n", F.posexplode("idx").alias("k", "slice_no"))
    return with_position(rows)


def with_position(df: DataFrame, centre: str = "slice_no", n: str = "n", legacy: bool = False) -> DataFrame:
    last = F.greatest(F.col(n) - 1, F.lit(1)) if legacy else F.col(n) - 1
    return df.withColumn("position", F.try_divide(F.col(centre).cast("double"), last.cast("double")))


def neighbour_windows(centres: DataFrame, centre: str = "centre", n: str = "n") -> DataFrame:
    """Rows centre-1, centre, centre+1, clamped to the series."""
    clamp = lambda d: F.greatest(F.lit(0), F.least(F.col(n).cast("int") - 1, F.col(centre).cast("int") + d))
    return centres.select("*", F.posexplode(F.array(clamp(-1), clamp(0), clamp(1))).alias("channel", "slice_no"))


def ownership(selected: DataFrame, shards: list[int]) -> DataFrame:
    """`owned` per globally selected slot. Selection comes first: filtering series
    by shard before `select_series` would choose other series."""
    return selected.withColumn("owned", F.col("shard").isin(*shards))


def plan_lines(selected: DataFrame, k: int = 4) -> DataFrame:
    idx = F.array_join(F.transform(slice_indices("n", k), lambda i: i.cast("string")), ",")
    text = lambda c: F.col(c).cast("string")
    return selected.select("study_id", "slot", F.concat_ws(":", "study_id", text("slot"), "series_id", text("shard"), idx).alias("line"))


def plan_summary(series: DataFrame, selected: DataFrame, k: int = 4) -> DataFrame:
    """One row: studies, series, selected series and images."""
    a = series.agg(F.count(F.lit(1)).alias("series")).withColumn("_j", F.lit(1))
    per = selected.groupBy("study_id").agg(F.count(F.lit(1)).alias("c"))
    b = per.agg(F.count(F.lit(1)).alias("studies"), F.sum("c").alias("selected_series")).withColumn("_j", F.lit(1))
    return a.join(b, "_j").select("studies", "series", "selected_series", (F.col("selected_series") * k).alias("images"))


def union_shards(shards: dict[int, DataFrame], expected: set[int]) -> DataFrame:
    """Tagged union; the shard set must be exactly the expected one."""
    if set(shards) != set(expected):
        raise ValueError(f"shards {sorted(shards)} differ from {sorted(expected)}")
    return reduce(DataFrame.unionByName, [df.withColumn("shard", F.lit(s)) for s, df in sorted(shards.items())])


def expect_one_shard(tagged: DataFrame, key: str = "series_id") -> DataFrame:
    per = tagged.groupBy(key).count()
    return rule_table(per, key, {"repeated_across_shards": F.col("count") > 1})

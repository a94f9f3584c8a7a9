"""Slices and pixels in long form: order, cap, gaps, intensity, crop and pooling."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalars as S
from .ordering import HOT_ROWS, exact_quantiles, with_row_number


def series_frame(headers: DataFrame) -> DataFrame:
    """Per series: first known orientation in listing order, normal, plane, and
    whether every slice has a position. Two aggregates only, combined map-side."""
    agg = headers.groupBy("series_id").agg(
        F.min_by("orientation", F.when(F.col("orientation").isNotNull(), F.col("ordinal"))).alias("orientation0"),
        F.every(F.col("ipp").isNotNull()).alias("all_positions"), F.min("plane_name").alias("plane_name"), F.count(F.lit(1)).alias("n_slices"))
    named = F.array_position(F.array(*[F.lit(p) for p in G.PLANES]), F.col("plane_name")) - 1
    fallback = F.when(named >= 0, named).otherwise(F.lit(0)).cast("int")
    normal = G.slice_normal("orientation0")
    return agg.select("series_id", "n_slices", "all_positions", "orientation0", normal.alias("normal"),
                      F.coalesce(G.argmax_abs(normal), fallback).alias("plane"))


def order_slices(headers: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """0-based slice_no inside each series.

    headers(series_id, ordinal, frame, instance, orientation[6], ipp[3],
    plane_name). Along the normal when orientation and all positions are known,
    else by instance number plus 1e-3 per frame; equal keys keep listing order.
    """
    frame = series_frame(headers).drop("orientation0")
    joined = headers.join(frame, "series_id")
    spatial = F.col("normal").isNotNull() & F.col("all_positions")
    sign = G.pick(G.ORDER_SIGN, "plane") * F.signum(F.element_at("normal", F.col("plane") + 1))
    along = F.when(spatial, G.dot3("ipp", "normal"))
    key = F.when(spatial, along * sign).otherwise(F.col("instance").cast("double") + F.col("frame") * S.dbl(1e-3))
    keyed = joined.withColumn("along", along).withColumn("_key", key)
    out = with_row_number(keyed, ["series_id"], [F.col("_key").asc(), F.col("ordinal").asc()], "slice_no", hot_rows)
    return out.withColumn("slice_no", F.col("slice_no") - 1).drop("_key")


def cap_rows(ordered: DataFrame, cap: int = G.MAX_SLICES) -> DataFrame:
    """At most `cap` evenly spaced slices per series (n_slices from order_slices);
    renumbers nothing, so slice_no stays the original ordinal."""
    return ordered.filter(G.kept_by_cap("slice_no", "n_slices", cap))


def gap_median(ordered: DataFrame) -> DataFrame:
    """Median distance of neighbouring slices along the normal; 0 for one slice.
    Series without positions have no row."""
    at = ordered.filter(F.col("along").isNotNull()).select("series_id", "slice_no", "along")
    ahead = at.select("series_id", (F.col("slice_no") - 1).alias("slice_no"), F.col("along").alias("_next"))
    gaps = at.join(ahead, ["series_id", "slice_no"]).select("series_id", F.abs(F.col("_next") - F.col("along")).alias("gap"))
    medians = exact_quantiles(gaps, ["series_id"], "gap", {"slice_gap": 0.5}).drop("n_values")
    return at.select("series_id").distinct().join(medians, "series_id", "left").withColumn("slice_gap", F.coalesce("slice_gap", S.dbl(0)))


# ---- pixels: (series_id, slice_no, row, col, value) ---------------------------

def intensity_window(pixels: DataFrame, key: str = "series_id", value: str = "value", stride: int = 4,
                     low: float = 0.01, high: float = 0.995) -> DataFrame:
    """Scale each series to 0..255 between two percentiles of a strided sample."""
    sample = pixels.filter((F.col("row") % stride == 0) & (F.col("col") % stride == 0)).select(key, value)
    bounds = exact_quantiles(sample, [key], value, {"_lo": low, "_hi": high}).drop("n_values")
    unit = (F.col(value) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), S.dbl(1e-6))
    level = F.rint(F.greatest(S.dbl(0), F.least(S.dbl(1), unit)) * S.dbl(255)).cast("int")
    return pixels.join(bounds, key).withColumn("level", level).drop("_lo", "_hi")


def rescale(pixels: DataFrame, keys: list[str], slope: str = "slope", intercept: str = "intercept", invert: str = "invert") -> DataFrame:
    """Inversion (image maximum minus value) first, then slope and intercept if both exist."""
    top = pixels.filter(F.col(invert)).groupBy(*keys).agg(F.max("value").alias("_top"))
    joined = pixels.join(top, keys, "left")
    raw = F.when(F.col(invert), F.col("_top") - F.col("value")).otherwise(F.col("value"))
    both = F.col(slope).isNotNull() & F.col(intercept).isNotNull()
    return joined.withColumn("value", F.when(both, raw * F.col(slope) + F.col(intercept)).otherwise(raw)).drop("_top")


def pixel_crop(pixels: DataFrame, h: int, w: int, fov: float = 0.92) -> DataFrame:
    """Centred crop of fov * shorter side; row and col restart at the crop corner."""
    b = G.centre_crop_bounds(F.lit(h), F.lit(w), fov)
    row, colm = F.col("row") - b["top"], F.col("col") - b["left"]
    return (pixels.filter((row >= 0) & (row < b["crop"]) & (colm >= 0) & (colm < b["crop"]))
            .withColumn("row", row.cast("int")).withColumn("col", colm.cast("int")))


def avg_pool2(pixels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean over 2 x 2 blocks; an odd last row or column is dropped by the caller's crop."""
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    return pixels.groupBy(*keys, half("row"), half("col")).agg(F.avg(value).alias(value))


def channel_normalise(pixels: DataFrame, value: str = "level") -> DataFrame:
    """One row per channel: (value / 255 - mean) / std."""
    rows = F.array(*[F.struct(F.lit(i).alias("channel"), ((F.col(value) / S.dbl(255) - S.dbl(m)) / S.dbl(s)).alias("z"))
                     for i, (m, s) in enumerate(zip(G.MEAN, G.STD))])
    return pixels.withColumn("_c", F.explode(rows)).select(*pixels.columns, "_c.*")

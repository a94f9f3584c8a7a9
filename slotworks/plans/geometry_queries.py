"""Slice order, geometry and long pixels from the event stream."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalars as S
from ..operators import slices as SL
from . import roles as R
from .registry import query
from .role_sql import r6


@query("w04_order_slices", f"SELECT series_id, ordinal, slice_no, CAST(plane AS BIGINT) AS plane FROM fx_ordered")
def w04(t):
    return SL.order_slices(R.headers(t)).select("series_id", "ordinal", "slice_no", "plane")


@query("w05_cap_rows", """SELECT series_id, slice_no FROM fx_ordered o WHERE n_slices <= 24
    OR EXISTS (SELECT 1 FROM (SELECT unnest(range(24)) AS i) g WHERE round_even(g.i * ((o.n_slices - 1) / 23.0::DOUBLE), 0) = o.slice_no)""")
def w05(t):
    return SL.cap_rows(SL.order_slices(R.headers(t)), 24).select("series_id", "slice_no")


@query("a15_gap_median", f"""SELECT series_id, {r6('coalesce(quantile_cont(gap, 0.5::DOUBLE), 0)')} AS slice_gap
    FROM (SELECT series_id, abs(along - lag(along) OVER (PARTITION BY series_id ORDER BY slice_no)) AS gap FROM fx_ordered WHERE along IS NOT NULL) GROUP BY series_id""")
def a15(t):
    return SL.gap_median(SL.order_slices(R.headers(t)))


WINDOW = """SELECT p.series_id, p."row", p."col", p.value, CAST(round_even(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (p.value - q.lo) / greatest(q.hi - q.lo, 0.000001::DOUBLE))) * 255, 0) AS BIGINT) AS level
    FROM fx_pixels p JOIN (SELECT series_id, quantile_cont(value, 0.01::DOUBLE) AS lo, quantile_cont(value, 0.995::DOUBLE) AS hi FROM fx_pixels WHERE "row" % 4 = 0 AND "col" % 4 = 0 GROUP BY series_id) q USING (series_id)"""


@query("a14_intensity_window", f'SELECT series_id, CAST("row" AS BIGINT) AS "row", CAST("col" AS BIGINT) AS "col", level FROM ({WINDOW})')
def a14(t):
    return SL.intensity_window(R.pixels(t)).select("series_id", "row", "col", "level")


@query("f06_slice_normal", f"""SELECT series_id, ordinal, {r6('n[1]')} AS nx, {r6('n[2]')} AS ny, {r6('n[3]')} AS nz, {r6('ipp[1]*n[1] + ipp[2]*n[2] + ipp[3]*n[3]')} AS along,
      CASE WHEN o IS NOT NULL THEN CAST(list_position(list_transform(n, lambda x: abs(x)), list_max(list_transform(n, lambda x: abs(x)))) - 1 AS BIGINT) END AS plane
    FROM (SELECT series_id, ordinal, ipp, o, [o[2]*o[6]-o[3]*o[5], o[3]*o[4]-o[1]*o[6], o[1]*o[5]-o[2]*o[4]] AS n FROM fx_headers)""")
def f06(t):
    h = R.headers(t).withColumn("n", G.slice_normal("orientation"))
    n = F.col("n")
    return h.select("series_id", "ordinal", n[0].alias("nx"), n[1].alias("ny"), n[2].alias("nz"), G.dot3("ipp", "n").alias("along"), G.argmax_abs("n").alias("plane"))


FLIPS = """SELECT series_id, ordinal, h, w, coalesce(swap, FALSE) AS transpose, CASE WHEN o IS NULL THEN FALSE ELSE (CASE WHEN swap THEN o[3 + ca + 1] ELSE o[ca + 1] END) < 0 END AS flip_x,
      CASE WHEN o IS NULL THEN FALSE ELSE (CASE WHEN swap THEN o[ra + 1] ELSE o[3 + ra + 1] END) * rs < 0 END AS flip_y,
      CASE WHEN coalesce(swap, FALSE) THEN sp1 ELSE sp0 END AS row_mm, CASE WHEN coalesce(swap, FALSE) THEN sp0 ELSE sp1 END AS col_mm
    FROM (SELECT *, abs(o[ca + 1]) < abs(o[ra + 1]) AS swap FROM (SELECT h.*, CASE f.plane WHEN 0 THEN 1 ELSE 0 END AS ca, CASE f.plane WHEN 2 THEN 1 ELSE 2 END AS ra, CASE f.plane WHEN 2 THEN 1 ELSE -1 END AS rs
          FROM fx_headers h JOIN fx_frame f USING (series_id)))"""


def flips(t):
    h = R.headers(t)
    plane = SL.series_frame(h).select("series_id", "plane")
    j = h.join(plane, "series_id")
    return j.select("series_id", "ordinal", "h", "w", *[c.alias(n) for n, c in G.slice_flips("orientation", "plane", "spacing").items()])


@query("f07_slice_flips", f"SELECT series_id, ordinal, transpose, flip_x, flip_y, {r6('row_mm')} AS row_mm, {r6('col_mm')} AS col_mm FROM ({FLIPS})")
def f07(t):
    return flips(t).drop("h", "w")


@query("f08_resample_plan", f"""WITH s AS (SELECT series_id, ordinal, h, w, coalesce(row_mm, 0.4::DOUBLE * h / 384) AS rm, coalesce(col_mm, 0.4::DOUBLE * h / 384) AS cm FROM ({FLIPS})),
    c AS (SELECT *, least(h, CAST(round_even(384 * 0.4::DOUBLE / rm, 0) AS BIGINT)) AS ch, least(w, CAST(round_even(384 * 0.4::DOUBLE / cm, 0) AS BIGINT)) AS cw FROM s),
    n AS (SELECT *, greatest(1, least(384, CAST(round_even(ch * rm / 0.4::DOUBLE, 0) AS BIGINT))) AS nh, greatest(1, least(384, CAST(round_even(cw * cm / 0.4::DOUBLE, 0) AS BIGINT))) AS nw FROM c)
    SELECT series_id, ordinal, ch AS crop_h, cw AS crop_w, (h - ch) // 2 AS top, (w - cw) // 2 AS "left", nh AS new_h, nw AS new_w, (384 - nh) // 2 AS pad_top, (384 - nw) // 2 AS pad_left,
           CASE WHEN nh < ch THEN 'area' ELSE 'linear' END AS resize FROM n""")
def f08(t):
    return flips(t).select("series_id", "ordinal", *[c.alias(n) for n, c in G.resample_plan("h", "w", "row_mm", "col_mm").items()])


@query("f09_centre_crop_bounds", """SELECT series_id, ordinal, crop, (h - crop) // 2 AS top, (w - crop) // 2 AS "left" FROM (SELECT *, greatest(1, CAST(round_even(least(h, w) * 0.92::DOUBLE, 0) AS BIGINT)) AS crop FROM fx_headers)""")
def f09(t):
    return R.headers(t).select("series_id", "ordinal", *[c.alias(n) for n, c in G.centre_crop_bounds("h", "w").items()])


@query("f10_crop_pool_normalise", f"""WITH c AS (SELECT series_id, "row" - 1 AS r, "col" - 1 AS c, level FROM ({WINDOW}) WHERE "row" BETWEEN 1 AND 14 AND "col" BETWEEN 1 AND 14),
    p AS (SELECT series_id, r // 2 AS r, c // 2 AS c, avg(level) AS level FROM c GROUP BY ALL)
    SELECT series_id, CAST(r AS BIGINT) AS "row", CAST(c AS BIGINT) AS "col", {r6('level')} AS level, CAST(ch AS BIGINT) AS channel, {r6('(level / 255.0::DOUBLE - m) / s')} AS z
    FROM p, (VALUES (0, 0.485::DOUBLE, 0.229::DOUBLE), (1, 0.456::DOUBLE, 0.224::DOUBLE), (2, 0.406::DOUBLE, 0.225::DOUBLE)) AS v(ch, m, s)""")
def f10(t):
    px = SL.intensity_window(R.pixels(t)).select("series_id", "row", "col", "level")
    return SL.channel_normalise(SL.avg_pool2(SL.pixel_crop(px, 16, 16, 0.9), ["series_id"], "level"))


@query("f11_rescale", f"""WITH p AS (SELECT *, CAST(series_id AS BIGINT) % 2 = 0 AS inv, CASE WHEN CAST(series_id AS BIGINT) % 5 <> 0 THEN 1.5::DOUBLE END AS slope FROM fx_pixels),
    q AS (SELECT *, CASE WHEN inv THEN max(value) OVER (PARTITION BY series_id) - value ELSE value END AS v FROM p)
    SELECT series_id, CAST("row" AS BIGINT) AS "row", CAST("col" AS BIGINT) AS "col", {r6('CASE WHEN slope IS NOT NULL THEN v * slope - 10 ELSE v END')} AS value FROM q""")
def f11(t):
    s = F.col("series_id").cast("bigint")
    px = R.pixels(t).withColumn("invert", s % 2 == 0).withColumn("slope", F.when(s % 5 != 0, S.dbl(1.5))).withColumn("intercept", S.dbl(-10))
    return SL.rescale(px, ["series_id"]).select("series_id", "row", "col", "value")

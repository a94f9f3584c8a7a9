"""Slice geometry in patient coordinates, as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col, dbl

PLANES = ["Sagittal", "Coronal", "Axial"]
SIDE = 384          # canonical pixels per side
MM_PER_PIXEL = 0.4  # canonical spacing
MAX_SLICES = 64

# Fixed values per plane index: sign of the slice order along the normal axis,
# then (axis, sign) of image columns and of image rows.
ORDER_SIGN = [1, 1, -1]
COLUMN_AXIS, COLUMN_SIGN = [1, 0, 0], [1, 1, 1]
ROW_AXIS, ROW_SIGN = [2, 2, 1], [-1, -1, 1]

MEAN = (0.485, 0.456, 0.406)  # fixed values: channel mean and spread
STD = (0.229, 0.224, 0.225)


def pick(values, index) -> Column:
    """values[index] for a short fixed list and an integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), col(index).cast("int") + 1)


def vec3(v, start=0):
    v = col(v)
    return [v.getItem(start + i).cast("double") for i in range(3)]


def cross3(a, b) -> Column:
    (a0, a1, a2), (b0, b1, b2) = vec3(a), vec3(b)
    return F.array(a1 * b2 - a2 * b1, a2 * b0 - a0 * b2, a0 * b1 - a1 * b0)


def dot3(a, b) -> Column:
    (a0, a1, a2), (b0, b1, b2) = vec3(a), vec3(b)
    return a0 * b0 + a1 * b1 + a2 * b2


def argmax_abs(v) -> Column:
    """Index (0-based) of the first element of greatest magnitude."""
    size = F.transform(col(v), lambda x: F.abs(x))
    return (F.array_position(size, F.array_max(size)) - 1).cast("int")


def slice_normal(orientation) -> Column:
    o = col(orientation)
    return F.when(o.isNotNull(), cross3(F.slice(o, 1, 3), F.slice(o, 4, 3)))


def slice_flips(orientation, plane, spacing) -> dict[str, Column]:
    """transpose / flip_x / flip_y flags and the spacing after a transpose.

    Without orientation nothing is flipped.
    """
    o, sp = col(orientation), col(spacing)
    ca, ra = pick(COLUMN_AXIS, plane), pick(ROW_AXIS, plane)
    r_at = lambda axis: F.element_at(F.slice(o, 1, 3), axis + 1)
    c_at = lambda axis: F.element_at(F.slice(o, 4, 3), axis + 1)
    swap = F.abs(r_at(ca)) < F.abs(r_at(ra))
    row, colm = F.when(swap, c_at(ca)).otherwise(r_at(ca)), F.when(swap, r_at(ra)).otherwise(c_at(ra))
    has = o.isNotNull()
    swap = F.when(has, swap).otherwise(F.lit(False))
    return {
        "transpose": swap,
        "flip_x": F.when(has, row * pick(COLUMN_SIGN, plane) < 0).otherwise(F.lit(False)),
        "flip_y": F.when(has, colm * pick(ROW_SIGN, plane) < 0).otherwise(F.lit(False)),
        "row_mm": F.when(swap, sp.getItem(1)).otherwise(sp.getItem(0)),
        "col_mm": F.when(swap, sp.getItem(0)).otherwise(sp.getItem(1)),
    }


def resample_plan(h, w, row_mm, col_mm, side: int = SIDE, mm: float = MM_PER_PIXEL) -> dict[str, Column]:
    """Crop size and origin, resized size, pad offset and resize kind.

    Missing spacing means that the image spans the whole crop. rint is
    half-to-even, and halves floor as integers.
    """
    h, w = col(h).cast("int"), col(w).cast("int")
    default = dbl(mm) * h / dbl(side)
    rmm, cmm = F.coalesce(col(row_mm), default), F.coalesce(col(col_mm), default)
    field = dbl(side * mm)
    ch = F.least(h, F.rint(field / rmm).cast("int"))
    cw = F.least(w, F.rint(field / cmm).cast("int"))
    fit = lambda n, s: F.greatest(F.lit(1), F.least(F.lit(side), F.rint(n * s / dbl(mm)).cast("int")))
    nh, nw = fit(ch, rmm), fit(cw, cmm)
    half = lambda x: F.floor(x / 2).cast("int")
    return {"crop_h": ch, "crop_w": cw, "top": half(h - ch), "left": half(w - cw), "new_h": nh, "new_w": nw,
            "pad_top": half(side - nh), "pad_left": half(side - nw),
            "resize": F.when(nh < ch, F.lit("area")).otherwise(F.lit("linear"))}


def centre_crop_bounds(h, w, fov: float = 0.92) -> dict[str, Column]:
    h, w = col(h).cast("int"), col(w).cast("int")
    crop = F.greatest(F.lit(1), F.rint(F.least(h, w) * dbl(fov)).cast("int"))
    return {"crop": crop, "top": F.floor((h - crop) / 2).cast("int"), "left": F.floor((w - crop) / 2).cast("int")}


# ---- evenly spaced indices --------------------------------------------------

def spaced(lo, hi, k: int) -> list[Column]:
    """k evenly spaced DOUBLEs from lo to hi, one column each; a single point sits at lo.

    Plain columns: inside a lambda the ends would be computed anew for every point, without generated code.
    """
    lo, hi = col(lo).cast("double"), col(hi).cast("double")
    if k == 1:
        return [lo]
    step = (hi - lo) / dbl(k - 1)
    return [dbl(i) * step + lo for i in range(k - 1)] + [hi]


def linspace(lo, hi, k: int) -> Column:
    """`spaced` as one array."""
    return F.array(*spaced(lo, hi, k))


def slice_indices(n, k: int, lo: float = 0.04, hi: float = 0.96) -> Column:
    """Rounded even centres in [0, n-1]; NULL unless n >= 3 and k >= 1."""
    if k < 1:
        raise ValueError("at least one selected slice is needed")
    n = col(n).cast("int")
    points = linspace(dbl(lo) * (n - 1), dbl(hi) * (n - 1), k)
    return F.when(n >= 3, F.transform(points, lambda x: F.greatest(F.lit(0), F.least(n - 1, F.rint(x).cast("int")))))


def window_bounds(n, lo: float = 0.04, hi: float = 0.96):
    n = col(n).cast("double")
    a = F.greatest(dbl(1), dbl(lo) * (n - 1))
    b = F.least(n - 2, dbl(hi) * (n - 1))
    crossed = b < a
    mid = (n - 1) / dbl(2)
    return F.when(crossed, mid).otherwise(a), F.when(crossed, mid).otherwise(b)


def window_centres(n, k: int, lo: float = 0.04, hi: float = 0.96, jitter=None) -> Column:
    """Centres of three-slice windows. jitter(i) gives a uniform per cell i."""
    a, b = window_bounds(n, lo, hi)
    n = col(n).cast("int")
    if jitter is None:
        points = spaced(a, b, k)
    else:
        edges = spaced(a, b, k + 1)
        points = [e + jitter(F.lit(i)) * (f - e) for i, (e, f) in enumerate(zip(edges, edges[1:]))]
    top = F.greatest(F.lit(1), n - 2)
    return F.array(*[F.greatest(F.lit(1), F.least(top, F.rint(x).cast("int"))) for x in points])


def kept_by_cap(ordinal, n, cap: int = MAX_SLICES) -> Column:
    """True when 0-based `ordinal` is one of the rounded linspace(0, n-1, cap) points."""
    o, n = col(ordinal).cast("double"), col(n).cast("double")
    step = (n - 1) / dbl(cap - 1)
    near = F.rint(o / step)
    hit = lambda i: (i >= 0) & (i <= cap - 1) & (F.rint(i * step) == o)
    return (n <= cap) | hit(near) | hit(near - 1) | hit(near + 1)

"""Scalar expressions shared by every operator.

Everything here returns a Catalyst column, so it stays inside whole-stage
codegen and can be pushed, folded and pruned by the optimizer.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c):
    return F.col(c) if isinstance(c, str) else c


def dbl(value) -> Column:
    """A DOUBLE literal (bare SQL decimals would become DECIMAL)."""
    return F.lit(float(value))


def sigmoid(x) -> Column:
    """Logistic function that never exponentiates a positive number."""
    x = col(x).cast("double")
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, dbl(1) / (dbl(1) + e)).otherwise(e / (dbl(1) + e))


def logit(p, eps: float = 1e-4) -> Column:
    p = col(p).cast("double")
    q = F.when(p.isNotNull(), F.least(F.greatest(p, dbl(eps)), dbl(1 - eps)))
    return F.log(q) - F.log1p(-q)


def binarize(x, threshold: float = 0.5) -> Column:
    return (col(x) >= dbl(threshold)).cast("int")


def is_finite(x) -> Column:
    x = col(x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < dbl("inf"))


def null_if_nan(x) -> Column:
    x = col(x)
    return F.when(~F.isnan(x.cast("double")), x)


def hash_bits(*keys) -> Column:
    """32 pseudo-random bits as BIGINT from the ':'-joined key text."""
    text = F.concat_ws(":", *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_index(n, *keys) -> Column:
    """Pseudo-random index in [0, n) from 60 hash bits, for any realistic n."""
    text = F.concat_ws(":", *[col(k).cast("string") for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"), F.lit(n) if isinstance(n, int) else col(n))


def hash_uniform(*keys) -> Column:
    """Deterministic uniform in [0, 1); used wherever a random draw is needed.

    Pure in its keys, so repartitioning, retries and plan rewrites never
    change a draw (unlike rand() or monotonically_increasing_id()).
    """
    return hash_bits(*keys).cast("double") / dbl(4294967296)


def is_close(a, b, rtol: float, atol: float, symmetric: bool = True) -> Column:
    """Tolerance test. symmetric: |a-b| <= max(rtol*max(|a|,|b|), atol);
    otherwise |a-b| <= atol + rtol*|b|."""
    a, b = col(a).cast("double"), col(b).cast("double")
    if symmetric:
        bound = F.greatest(dbl(rtol) * F.greatest(F.abs(a), F.abs(b)), dbl(atol))
    else:
        bound = dbl(atol) + dbl(rtol) * F.abs(b)
    return F.abs(a - b) <= bound


def utc_micros(ts) -> Column:
    """Microseconds since 1970 of a zoneless timestamp read as UTC, whatever the
    session time zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col(ts).cast("timestamp_ntz"))


# ---- vectors ---------------------------------------------------------------

def dot(a, b) -> Column:
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, dbl(0), lambda acc, x: acc + x)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(col(v), dbl(0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def finite_all(v) -> Column:
    return F.forall(col(v), is_finite)


def max_abs(v) -> Column:
    return F.array_max(F.transform(col(v), lambda x: F.abs(x.cast("double"))))


HALF_MAX = 65520.0  # fixed value: smallest magnitude that rounds to infinity in IEEE binary16


def half_overflows(v) -> Column:
    return F.exists(col(v), lambda x: ~is_finite(x) | (F.abs(x.cast("double")) >= dbl(HALF_MAX)))


def round_half_precision(v) -> Column:
    """Round every element to IEEE binary16 (half-to-even) and keep it as FLOAT.

    The spacing of binary16 at x is 2^(max(floor(log2|x|), -14) - 10); rint is
    half-to-even, so scaling by that spacing reproduces a half-precision cast.
    A vector that overflows becomes NULL; report it with half_overflows.
    """
    def one(x):
        x = x.cast("double")
        step = F.pow(dbl(2), F.greatest(F.floor(F.log2(F.abs(x))).cast("double"), dbl(-14)) - dbl(10))
        return F.when(x == 0, x).otherwise(F.rint(x / step) * step).cast("float")

    return F.when(~half_overflows(v), F.transform(col(v), one))


# ---- text forms of digests, paths and byte ranges ---------------------------

def sha256_hex(x) -> Column:
    return F.sha2(col(x), 256)


def crc32_hex(x) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(col(x)))), 8, "0")


def is_hex(x, digits: int) -> Column:
    return F.coalesce(col(x).rlike(f"^[0-9a-f]{{{digits}}}$"), F.lit(False))


def safe_relative_path(p, single_name: bool = False) -> Column:
    """Relative, non-empty, without '..' parts; optionally one bare file name."""
    p = col(p)
    ok = (~p.startswith("/")) & (F.length(p) > 0) & (p != ".") & (~F.array_contains(F.split(p, "/"), ".."))
    if single_name:
        ok = ok & ~p.contains("/")
    return F.coalesce(ok, F.lit(False))


def resume_offset(header, total) -> Column:
    """Next byte after a `bytes=0-N` header; 0 without header; NULL if malformed."""
    header, total = col(header), col(total)
    last = F.expr("NULL").cast("bigint") if header is None else \
        F.when(header.rlike(r"^bytes=0-\d{1,18}$"), F.regexp_extract(header, r"^bytes=0-(\d+)$", 1)).cast("bigint")
    return F.when(header.isNull(), F.lit(0).cast("bigint")).when(last < total, last + 1)


def content_range_ok(header, start, end, total, length=None) -> Column:
    """`bytes a-b/total` equals the planned range, and the length if given."""
    header = col(header)
    want = F.concat(F.lit("bytes "), col(start).cast("string"), F.lit("-"), col(end).cast("string"),
                    F.lit("/"), col(total).cast("string"))
    ok = F.coalesce(header == want, F.lit(False))
    if length is not None:
        ok = ok & (col(length).isNull() | (col(length) == col(end) - col(start) + 1))
    return ok

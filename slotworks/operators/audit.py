"""Inventories, digests, manifests, receipts, capacity and run comparisons."""
from __future__ import annotations

import hashlib
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import pin, spread, stored
from .checks import coverage_report, rule_table
from .ordering import exact_quantiles


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key by `order` (then by the other columns): one aggregate with
    map-side combine instead of a sorted window, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_b")
    return spread(df, *keys).groupBy(*keys).agg(best).select(*keys, *[f"_b.`{c}`" for c in [*order, *rest]]).select(*df.columns)


def series_inventory(series: DataFrame) -> DataFrame:
    """(metric, value): series per study and slices per series (min, median, max),
    studies with a repeated slot. series(study_id, series_id, slot, n).

    Counts per study are stored: two results are made of them."""
    slot = series.groupBy("study_id", "slot").agg(F.count(F.lit(1)).alias("c"))
    study = stored(slot.groupBy("study_id").agg(F.sum("c").cast("double").alias("v"), F.max("c").alias("most")).select("v", "most"), "studies")
    q = {"min": 0.0, "median": 0.5, "max": 1.0}
    tidy = lambda df, pre, cols: df.select(F.explode(F.array(*[F.struct(F.lit(f"{pre}{c}").alias("metric"), F.col(c).cast("double").alias("value"))
                                                              for c in cols])).alias("r")).select("r.*")
    out = tidy(exact_quantiles(study, [], "v", q), "series_per_study_", q)
    out = out.unionByName(tidy(exact_quantiles(series.select(F.col("n").cast("double").alias("v")), [], "v", q), "slices_per_series_", q))
    return out.unionByName(tidy(study.agg(F.count_if(F.col("most") > 1).alias("repeated_slot_studies"), F.count(F.lit(1)).alias("studies")),
                                "", ["repeated_slot_studies", "studies"]))


def flag_redundancy(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cross-tab of two flags with each cell's share and the share of equal rows."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n")).withColumn("_j", F.lit(1))
    total = cells.groupBy("_j").agg(F.sum("n").alias("_all"), F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("n")).otherwise(F.lit(0))).alias("_eq"))
    return cells.join(F.broadcast(total), "_j").select("a", "b", "n", (F.col("n") / F.col("_all")).alias("share"), (F.col("_eq") / F.col("_all")).alias("equal_share"))


# ---- digests ------------------------------------------------------------------

TREE_LEVELS = 2  # 4096 ** 2 leaves, whatever the number of lines


def lines_digest(df: DataFrame, line: str, order: list[str], scheme: str = "tree2", terminate: bool = False) -> DataFrame:
    """One row (scheme, n, digest); the scheme alone decides the value, at any size.

    `tree2`: leaves are the lines that share the first six hex digits of their own
    sha256, sorted and joined by newline; two levels of 4096 then hash the
    'prefix<TAB>digest' lines of the one below. Repeated lines are counted map-side
    first and enter once, as line<TAB>*count.
    `sorted`: sha256 of all lines in `order`, joined by newline (`terminate` adds a
    newline behind each). Rows are sorted in parallel and pinned; as the digest is
    sequential by definition, one task then reads them batch by batch, in constant
    memory. Only by name, for agreement with digests taken elsewhere.
    """
    text = F.coalesce(F.col(line), F.lit(""))
    if scheme == "sorted":
        laid = pin(df.select(*order, text.alias("_line")).orderBy(*order, "_line")).select("_line")
        return laid.coalesce(1).mapInArrow(partial(_hash_lines, terminate), "scheme string, n bigint, digest string")
    if scheme != f"tree{TREE_LEVELS}":
        raise ValueError(scheme)
    once = df.groupBy(text.alias("_t")).agg(F.count(F.lit(1)).alias("_c"))
    entry = F.when(F.col("_c") == 1, F.col("_t")).otherwise(F.concat("_t", F.lit("\t*"), F.col("_c").cast("string")))
    node = once.select(F.substring(F.sha2("_t", 256), 1, 3 * TREE_LEVELS).alias("_p"), entry.alias("_l"), F.col("_c").alias("n"))
    joined = F.sha2(F.array_join(F.array_sort(F.collect_list("_l")), "\n"), 256)
    for level in range(TREE_LEVELS, 0, -1):
        per = node.groupBy("_p").agg(F.sum("n").alias("n"), joined.alias("_d"))
        node = per.select(F.substring("_p", 1, 3 * (level - 1)).alias("_p"), F.concat("_p", F.lit("\t"), "_d").alias("_l"), "n")
    return node.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), joined.alias("digest")).select(F.lit(scheme).alias("scheme"), "n", "digest")


def _hash_lines(terminate: bool, batches):
    digest, n = hashlib.sha256(), 0
    for batch in batches:
        for text in batch.column("_line").to_pylist():
            digest.update((text + "\n" if terminate else text if n == 0 else "\n" + text).encode())
            n += 1
    yield pa.RecordBatch.from_pydict({"scheme": ["sorted"], "n": [n], "digest": [digest.hexdigest()]})


def ids_digest(df: DataFrame, key: str, scheme: str = "tree2") -> DataFrame:
    """Digest of a set of ids; `sorted` is the sha256 of the sorted ids joined by newline."""
    return lines_digest(df.select(F.col(key).cast("string").alias("_id")), "_id", ["_id"], scheme)


def table_digest(df: DataFrame, name: str, size: str, sha: str, scheme: str = "tree2") -> DataFrame:
    """Digest of name<TAB>bytes<TAB>sha256 lines; `sorted` ends each by a newline."""
    line = F.concat_ws("\t", F.col(name), F.col(size).cast("string"), F.col(sha))
    return lines_digest(df.select(F.col(name).alias("_name"), line.alias("_l")), "_l", ["_name"], scheme, terminate=True)


def plan_digest(lines: DataFrame, scheme: str = "tree2") -> DataFrame:
    """Digest of study:slot:series:shard:i,j,k,l lines; `sorted` takes them in (study, slot) order."""
    return lines_digest(lines, "line", ["study_id", "slot"], scheme)


def config_identity(df: DataFrame, config: str, out: str = "identity") -> DataFrame:
    """sha256 of the JSON text of a string map with sorted keys, per row."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(F.col(config))))
    return df.withColumn(out, F.sha2(F.to_json(ordered), 256))


# ---- manifests ----------------------------------------------------------------

def reconcile(a: DataFrame, b: DataFrame, keys: list[str], exact: list[str], approx: list[str],
              rtol: float = 1e-7, atol: float = 1e-7) -> DataFrame:
    """Column-wise equality on matched keys; approx columns need the same NULLs and
    closeness. Keys must be unique and covered (coverage_report)."""
    right = b.select(*keys, *[F.col(c).alias(f"_{c}") for c in [*exact, *approx]])
    both = a.join(right, keys)
    rules = {c: ~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in exact}
    for c in approx:
        x, y = F.col(c), F.col(f"_{c}")
        rules[c] = (x.isNull() != y.isNull()) | F.coalesce(~S.is_close(x, y, rtol, atol), F.lit(False))
    return rule_table(both, F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), rules)


def manifest_join(manifest: DataFrame, observed: DataFrame, key: str, member_of: Column) -> DataFrame:
    """Declared members against observed metadata: exact coverage, member name,
    bytes, equal digests before and after, digest formats.

    manifest(key, member, logical_bytes, storage_bytes, sha_before, sha_after,
    crc32), observed(key, bytes).
    """
    cover = coverage_report(manifest, observed, [key])
    both = manifest.join(observed.select(key, F.col("bytes").alias("_bytes")), key)
    rules = rule_table(both, key, {
        "member_name": ~F.col("member").eqNullSafe(member_of), "unsafe_path": ~S.safe_relative_path("member"),
        "logical_bytes": ~F.col("logical_bytes").eqNullSafe(F.col("_bytes")),
        "storage_bytes": ~F.coalesce(F.col("storage_bytes") > 0, F.lit(False)),
        "digest_changed": ~F.col("sha_before").eqNullSafe(F.col("sha_after")),
        "sha_format": ~S.is_hex("sha_before", 64), "crc_format": ~S.is_hex("crc32", 8)})
    return cover.unionByName(rules)


def byte_ranges(archives: DataFrame, size: str = "bytes", chunk: int = 512 * 1024 * 1024) -> DataFrame:
    """(start, end, len) rows covering each archive in chunks."""
    starts = F.when(F.col(size) > 0, F.sequence(F.lit(0).cast("bigint"), F.col(size).cast("bigint") - 1, F.lit(chunk).cast("bigint")))
    rows = archives.withColumn("start", F.explode(starts))
    end = F.least(F.col("start") + chunk, F.col(size)) - 1
    return rows.withColumn("end", end).withColumn("len", F.col("end") - F.col("start") + 1)


# ---- receipts and capacity ------------------------------------------------------

def run_totals(receipts: DataFrame, min_slices: int = 3) -> DataFrame:
    """Decoded and unusable series, unreadable slices and encoded images.
    receipts(series_id, n, n_bad, images)."""
    return receipts.agg(F.count_if(F.col("n") >= min_slices).alias("decoded"), F.count_if(F.coalesce(F.col("n"), F.lit(0)) < min_slices).alias("unusable"),
                        F.coalesce(F.sum("n_bad"), F.lit(0)).alias("bad_slices"), F.coalesce(F.sum("images"), F.lit(0)).alias("images"))


def throughput(receipts: DataFrame, by: str = "shard") -> DataFrame:
    """Images/s, bytes/s and residual seconds per shard.
    receipts(shard, images, encode_seconds, bytes, download_seconds, total_seconds)."""
    s = receipts.groupBy(by).agg(*[F.sum(c).cast("double").alias(c) for c in ["images", "encode_seconds", "bytes", "download_seconds", "total_seconds"]])
    return s.select(by, F.try_divide("images", "encode_seconds").alias("images_per_second"), F.try_divide("bytes", "download_seconds").alias("bytes_per_second"),
                    (F.col("total_seconds") - F.col("download_seconds") - F.col("encode_seconds")).alias("residual_seconds"))


def conservative_envelope(rates: DataFrame) -> DataFrame:
    """Slowest rates and longest residual over the measured shards."""
    return rates.agg(F.min("images_per_second").alias("images_per_second"), F.min("bytes_per_second").alias("bytes_per_second"),
                     F.max("residual_seconds").alias("startup_seconds"))


def route_forecast(shards: DataFrame, rates: DataFrame, pilot_seconds: float, total_cap: float) -> DataFrame:
    """Projected seconds per shard and in total against the caps.

    shards(shard, bytes, images, cap_seconds), rates: one row (images_per_second,
    bytes_per_second, startup_seconds). Row shard = -1 is the total.
    """
    one = rates.withColumn("_j", F.lit(1))
    both = shards.withColumn("_j", F.lit(1)).join(F.broadcast(one), "_j")
    per = both.select(F.col("shard").cast("bigint").alias("shard"), F.try_divide(F.col("bytes").cast("double"), F.col("bytes_per_second")).alias("transport_seconds"),
                      F.col("startup_seconds"), F.try_divide(F.col("images").cast("double"), F.col("images_per_second")).alias("encode_seconds"),
                      F.col("cap_seconds").cast("double").alias("cap_seconds"))
    per = per.withColumn("projected_seconds", F.col("transport_seconds") + F.col("startup_seconds") + F.col("encode_seconds"))
    total = per.agg(*[F.sum(c).alias(c) for c in ["transport_seconds", "startup_seconds", "encode_seconds"]],
                    (F.sum("projected_seconds") + S.dbl(pilot_seconds)).alias("projected_seconds"))
    total = total.select(F.lit(-1).cast("bigint").alias("shard"), "transport_seconds", "startup_seconds", "encode_seconds",
                         S.dbl(total_cap).alias("cap_seconds"), "projected_seconds")
    return per.unionByName(total).withColumn("fits", F.col("projected_seconds") <= F.col("cap_seconds"))


def pilot_rates(pilot: DataFrame, archives: DataFrame) -> DataFrame:
    """Rates from pilot receipts that match the declared archive on origin, size and
    digest; startup keeps everything that was not download. Others drop out."""
    want = archives.select("shard", F.col("origin").alias("_o"), F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    ok = ((F.col("origin") == F.col("_o")) & (F.col("bytes") == F.col("_b")) & (F.col("sha256") == F.col("_s"))
          & (F.col("download_seconds") > 0) & (F.col("encode_seconds") > 0) & (F.col("startup_total") >= F.col("download_seconds")))
    return pilot.join(want, "shard").filter(ok).select(
        "shard", (F.col("bytes") / F.col("download_seconds")).alias("bytes_per_second"), (F.col("images") / F.col("encode_seconds")).alias("images_per_second"),
        (F.col("startup_total") - F.col("download_seconds")).alias("startup_seconds"))


def allocate_caps(shards: DataFrame, pool: float, reserve: float, images: str = "images") -> DataFrame:
    """floor(pool * images / total) + reserve per shard."""
    # one row by construction, hence the broadcast
    total = shards.agg(F.sum(images).alias("_total")).withColumn("_j", F.lit(1))
    share = F.floor(S.dbl(pool) * F.col(images) / F.col("_total")) + F.lit(reserve).cast("bigint")
    return shards.withColumn("_j", F.lit(1)).join(F.broadcast(total), "_j").withColumn("cap_seconds", share).drop("_j", "_total")

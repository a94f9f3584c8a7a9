"""Readers and sinks. Sink queries write to the shared scratch folder and
read their own output back."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import labels as L
from ..session import scratch_path
from ..sources import banks, sinks, tables
from . import roles as R
from .registry import query
from .role_sql import r6


@query("s01_read_studies", f"SELECT CAST(doc_id AS VARCHAR) AS study_id, CAST(length(text) AS BIGINT) AS report_chars, {r6('n_chars')} AS n_chars FROM documents")
def s01(t):
    df = tables.read_studies(t.spark, t.path("documents"), ["n_chars"], key="doc_id", report="text")
    return df.select("study_id", F.char_length("report").alias("report_chars"), "n_chars")


@query("s02_read_series", """SELECT plane, CAST(fat_sup AS BIGINT) AS fat_sup, count(*) AS n, count(DISTINCT study_id) AS studies
    FROM (SELECT l_orderkey AS study_id, l_linenumber AS fat_sup, l_returnflag AS plane FROM lineitem) GROUP BY ALL""")
def s02(t):
    df = tables.read_series(t.spark, t.path("lineitem"), {"study_id": "l_orderkey", "series_id": "l_partkey", "fat_sup": "l_linenumber", "plane": "l_returnflag"})
    return df.groupBy("plane", "fat_sup").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("study_id").alias("studies"))


@query("s03_read_label_sources", f"""
    SELECT 'own' AS source, CAST(doc_id AS VARCHAR) AS study_id, 'first' AS label, {r6('quality')} AS p FROM labels
    UNION ALL SELECT 'own', CAST(doc_id AS VARCHAR), 'second', {r6('toxic')} FROM labels
    UNION ALL SELECT 'swapped', CAST(doc_id AS VARCHAR), 'first', {r6('toxic')} FROM labels
    UNION ALL SELECT 'swapped', CAST(doc_id AS VARCHAR), 'second', {r6('quality')} FROM labels""")
def s03(t):
    path = t.path("labels")
    files = {"own": (path, {"quality": "first", "toxic": "second"}), "swapped": (path, {"toxic": "first", "quality": "second"})}
    return tables.read_label_sources(t.spark, files, ["first", "second"], key="doc_id")


@query("s04_read_grades_jsonl", "SELECT study_id, label, grade FROM fx_grades")
def s04(t):
    keys = {"effusion": "Effusion", "synovitis": "Synovitis", "acl": "ACL"}
    wide = L.pivot_labels(R.grades(t), ["study_id"], list(keys.values()), "grade")
    out = scratch_path(t.spark, "grades")
    wide.select(F.col("study_id").alias("study"), *[F.col(v).alias(k) for k, v in keys.items()]).write.json(out)
    return tables.read_grades_jsonl(t.spark, out, keys)


@query("s05_read_manifest", "SELECT member AS path, bytes, sha AS sha256 FROM fx_manifest")
def s05(t):
    out = scratch_path(t.spark, "manifest")
    R.manifest(t).select(F.col("member").alias("path"), "bytes", F.col("sha").alias("sha256")).write.json(out)
    return tables.read_manifest(t.spark, out, "path string, bytes bigint, sha256 string", lines=True)


@query("s06_read_bank", f"""SELECT study_id, slot, k, {r6('position')} AS position, {r6('sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))')} AS norm FROM fx_bank""")
def s06(t):
    out = scratch_path(t.spark, "bank")
    banks.write_bank(R.bank(t), out)
    return banks.read_bank(t.spark, out).select("study_id", "slot", "k", "position", S.l2_norm("embedding").alias("norm"))


@query("s06b_import_npz_bank", f"SELECT study_id, slot, k, {r6('position')} AS position, 64::BIGINT AS width FROM fx_bank")
def s06b(t):
    out = scratch_path(t.spark, "npz")
    files = banks.export_npz_bank(R.bank(t), out)
    listed = scratch_path(t.spark, "npz-list")
    files.write.parquet(listed)  # one pass writes the files
    bank = banks.import_npz_bank(t.spark.read.parquet(listed), R.IDENTITY, width=R.WIDTH)
    return bank.select("study_id", "slot", "k", "position", F.size("embedding").alias("width"))


def volumes(t):
    """16 slices of 4 x 4 pixels per series, from the long pixels."""
    px = R.pixels(t).withColumn("v", F.least(F.lit(255), F.floor("value")).cast("float"))
    wide = px.groupBy("series_id", F.col("col").cast("int").alias("slice_no")).pivot("row", list(range(16))).agg(F.first("v"))
    dense = wide.select("series_id", "slice_no", F.array(*[F.coalesce(f"`{i}`", F.lit(0.0)).cast("float") for i in range(16)]).alias("pixels"))
    full = dense.select("series_id").distinct().select("series_id", R.fan(list(range(16)), "slice_no"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), 16)
    return full.join(dense, ["series_id", "slice_no"], "left").withColumn("pixels", F.coalesce("pixels", zeros))


def stored_volumes(t):
    folder, listed = scratch_path(t.spark, "volumes"), scratch_path(t.spark, "volume-list")
    banks.write_npy_series(volumes(t), folder, 4).write.parquet(listed)
    return folder, t.spark.read.parquet(listed)


@query("s07_read_slices", f"""SELECT s.series_id, CAST(c.slice_no AS BIGINT) AS slice_no, {r6('coalesce(sum(CASE WHEN p.value IS NOT NULL THEN least(255, floor(p.value)) END), 0)')} AS pixel_sum
    FROM (SELECT DISTINCT series_id FROM fx_pixels) s CROSS JOIN (SELECT unnest(range(16)) AS slice_no) c
    LEFT JOIN fx_pixels p ON p.series_id = s.series_id AND p.col = c.slice_no GROUP BY ALL""")
def s07(t):
    _, listed = stored_volumes(t)
    return banks.read_slices(listed, 4).select("series_id", "slice_no", F.aggregate("pixels", S.dbl(0), lambda a, x: a + x).alias("pixel_sum"))


@query("s08_inventory_files", """SELECT DISTINCT series_id, 1::BIGINT AS n_files FROM fx_pixels
    UNION ALL SELECT DISTINCT 'absent-' || series_id, 0::BIGINT FROM fx_pixels""")
def s08(t):
    folder, listed = stored_volumes(t)
    ids = listed.select("series_id")
    wanted = ids.unionByName(ids.select(F.concat(F.lit("absent-"), "series_id").alias("series_id")))
    return banks.inventory_files(t.spark, folder, wanted, pattern="*.npy")


@query("s09_write_bank", "SELECT CAST(shard AS BIGINT) AS shard, count(*) AS n, count(DISTINCT study_id) AS studies FROM fx_bank_plan GROUP BY ALL")
def s09(t):
    out = scratch_path(t.spark, "bank")
    banks.write_bank(R.bank(t), out)
    return banks.read_bank(t.spark, out).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("study_id").alias("studies"))


@query("s10_write_predictions", f"""SELECT study_id, {r6("max(score) FILTER (label = 'quality')")} AS quality, {r6("max(score) FILTER (label = 'toxic')")} AS toxic,
    {r6("max(score) FILTER (label = 'english')")} AS english FROM fx_predictions WHERE model = 'a' GROUP BY study_id""")
def s10(t):
    out = scratch_path(t.spark, "predictions")
    sinks.write_predictions(R.predictions(t).filter("model = 'a'"), out, R.LABELS, "score")
    return t.spark.read.schema("study_id string, quality double, toxic double, english double").option("header", True).csv(out)


@query("s11_publish_once", "SELECT label, count(*) AS n, TRUE AS second_refused, 1::BIGINT AS receipts FROM fx_predictions GROUP BY label")
def s11(t):
    out = scratch_path(t.spark, "published")
    rows = R.predictions(t)
    receipt = t.spark.range(1).select(F.lit("predictions").alias("kind"))
    sinks.publish_once(rows, out, receipt)
    try:
        sinks.publish_once(rows, out, receipt)
        refused = False
    except FileExistsError:
        refused = True
    receipts = t.spark.read.schema("kind string").json(f"{out}/receipt").count()
    return t.spark.read.parquet(f"{out}/data").groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(
        "label", "n", F.lit(refused).alias("second_refused"), F.lit(receipts).cast("bigint").alias("receipts"))


@query("s12_write_report", f"""SELECT event_type AS metric, CASE WHEN event_type = 'error' THEN NULL ELSE {r6('avg(value)')} END AS value FROM events GROUP BY event_type""")
def s12(t):
    out = scratch_path(t.spark, "report")
    sinks.write_report(t.events.groupBy("event_type").agg(F.avg("value").alias("value")).select(
        F.col("event_type").alias("metric"), F.when(F.col("event_type") == "error", S.dbl("nan")).otherwise(F.col("value")).alias("value")), out)
    return t.spark.read.schema("metric string, value double").json(out)

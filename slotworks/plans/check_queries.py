"""Predicates, expectations and key sets."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import audit as A
from ..operators import checks as C
from ..operators import selection as SEL
from . import roles as R
from .registry import query
from .role_sql import r6, rules_sql, u


@query("p01_gold_flag", "SELECT study_id, quality IS NOT NULL AND toxic IS NOT NULL AND english IS NOT NULL AS is_gold FROM fx_official")
def p01(t):
    return C.gold_flag(R.official(t), R.LABELS).select("study_id", "is_gold")


@query("p02_expect_all_or_none", rules_sql("(SELECT study_id, quality, CASE WHEN CAST(study_id AS BIGINT) % 50 <> 1 THEN english END AS english FROM fx_official)", "study_id",
       {"partial_labels": "(quality IS NULL) <> (english IS NULL)"}))
def p02(t):
    holes = R.official(t).withColumn("english", F.when(F.col("study_id").cast("bigint") % 50 != 1, F.col("english")))
    return C.expect_all_or_none(holes, "study_id", R.LABELS)


@query("p03_binarize", "SELECT model, study_id, label, CASE WHEN score >= 0.5 THEN 1::BIGINT ELSE 0::BIGINT END AS decision FROM fx_predictions")
def p03(t):
    return R.predictions(t).select("model", "study_id", "label", S.binarize("score").alias("decision"))


@query("p04_expect_probability", rules_sql("""(SELECT event_id, CASE event_id % 100 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL ELSE value / 100.0::DOUBLE END AS p FROM events)""",
       "event_id", {"p:null": "p IS NULL", "p:nan": "isnan(p)", "p:infinite": "isinf(p)", "p:range": "NOT isnan(p) AND NOT isinf(p) AND (p < 0 OR p > 1)"}))
def p04(t):
    m = F.col("event_id") % 100
    p = F.when(m == 0, S.dbl("nan")).when(m == 1, S.dbl("inf")).when(m != 2, F.col("value") / 100)
    return C.expect_probability(t.events.select("event_id", p.alias("p")), "event_id", ["p"])


@query("p05_expect_ids", """WITH ids AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 'x' || CAST(l_orderkey AS VARCHAR)
                                      ELSE CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) END AS id FROM lineitem),
    per AS (SELECT id, count(*) AS n FROM ids GROUP BY id)
    SELECT 'null_id' AS rule, CAST(coalesce(sum(n) FILTER (id IS NULL), 0) AS BIGINT) AS n_violations, NULL AS sample_key FROM per
    UNION ALL SELECT 'bad_pattern', CAST(coalesce(sum(n), 0) AS BIGINT), min(id) FROM per WHERE NOT regexp_full_match(id, '\\d+(\\.\\d+)*')
    UNION ALL SELECT 'duplicate_id', CAST(coalesce(sum(n - 1), 0) AS BIGINT), min(id) FROM per WHERE id IS NOT NULL AND n > 1""")
def p05(t):
    ok = F.concat_ws(".", "l_orderkey", "l_linenumber")
    i = F.when(F.col("l_linenumber") == 7, F.lit(None)).when(F.col("l_linenumber") == 6, F.concat(F.lit("x"), R.text("l_orderkey"))).otherwise(ok)
    return C.expect_ids(t.lineitem.select(i.alias("id")), "id", C.STRICT_ID)


@query("p06_restrict_to_ids", f"SELECT CAST(event_id AS BIGINT) AS event_id, user_id, {r6('value')} AS value FROM events WHERE user_id IN (SELECT doc_id FROM labels)")
def p06(t):
    ids = t.labels.select(F.col("doc_id").alias("user_id"))
    return C.restrict_to_ids(t.events.select("event_id", "user_id", "value"), ids, "user_id")


@query("p07_with_slot", "SELECT study_id, series_id, slot FROM fx_slotted")
def p07(t):
    return R.slotted(t).select("study_id", "series_id", "slot")


@query("p07b_expect_slots", rules_sql("fx_series", "series_id", {"unknown_plane_or_flag": "plane = 'R'"}))
def p07b(t):
    return SEL.expect_slots(SEL.with_slot(R.series(t), ["A", "N"]))


@query("p08_usable_series", "SELECT study_id, series_id, n FROM fx_series WHERE n >= 3")
def p08(t):
    return SEL.usable_series(R.series(t)).select("study_id", "series_id", "n")


@query("p08b_expect_cached_series", rules_sql("fx_series", "series_id", {"n_range": "n < 3 OR n > 64", "n_raw": "n - 1 <= 0"}))
def p08b(t):
    return SEL.expect_cached_series(R.series(t).withColumn("n_raw", F.col("n") - 1))


@query("p09_split_roles", "SELECT study_id, role FROM fx_roles")
def p09(t):
    return R.roles(t).select("study_id", "role")


@query("p09b_expect_roles", """SELECT 'two_roles' AS rule, 0::BIGINT AS n_violations, NULL AS sample_key
    UNION ALL SELECT 'invalid_fold', count(*), min(study_id) FROM fx_roles WHERE NOT is_gold AND fold = 4
    UNION ALL SELECT 'empty_holdout', CASE WHEN count(*) FILTER (role = 'holdout') = 0 THEN 1 ELSE 0 END, NULL FROM fx_roles""")
def p09b(t):
    four = C.split_roles(R.roles(t).drop("role"), 0, n_folds=4)
    return C.expect_roles(four, "study_id")


@query("p10_complete_groups", """SELECT DISTINCT study_id FROM fx_series WHERE study_id NOT IN (SELECT study_id FROM fx_series WHERE n < 10)""")
def p10(t):
    s = R.series(t)
    return C.complete_groups(s.select("study_id", "series_id"), s.filter("n >= 10").select("series_id"), "study_id", "series_id")


@query("p11_schema_contract")
def p11(t):
    spec = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("text", T.StringType()),
                         T.StructField("n_chars", T.IntegerType()), T.StructField("fold", T.LongType())])
    return C.schema_contract(t.documents, spec)


@query("p12_pilot_subset", "SELECT study_id FROM fx_official WHERE quality IS NULL ORDER BY study_id LIMIT 16")
def p12(t):
    return C.pilot_subset(C.gold_flag(R.official(t), R.LABELS), "study_id", 16)



@query("p13_config_diff", f"""WITH e AS (SELECT event_id, event_type AS kind, CAST(event_id % 3 AS VARCHAR) AS seed, event_id % 10 <> 0 AS full_keys FROM events)
    SELECT CAST(a.event_id AS VARCHAR) AS left_run, CAST(b.event_id AS VARCHAR) AS right_run, a.full_keys = b.full_keys AS same_keys,
           concat_ws(',', CASE WHEN a.kind <> b.kind THEN 'kind' END, CASE WHEN a.seed <> b.seed THEN 'seed' END) AS changed,
           a.full_keys = b.full_keys AND a.kind <> b.kind AND a.seed = b.seed AS allowed
    FROM e a JOIN e b ON b.event_id = a.event_id + 3""")
def p13(t):
    e = F.col("event_id")
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    base = [entry("kind", F.col("event_type")), entry("seed", (e % 3).cast("string")), entry("epochs", F.lit("12"))]
    config = F.map_from_entries(F.when(e % 10 != 0, F.array(*base)).otherwise(F.array(*base[:2])))
    runs = t.events.select(R.text("event_id").alias("run_id"), config.alias("config"))
    top = t.events.select(e.cast("bigint").alias("event_id"))
    pairs = top.select(R.text("event_id").alias("left_run"), (e + 3).cast("string").alias("right_run"))
    return C.config_diff(runs, pairs, ["kind"])


@query("p14_expect_url_policy", rules_sql("pages", "page_id", {
    "scheme": "NOT starts_with(url, 'https://')", "host": "NOT regexp_matches(url, '^[a-z]+://([^/@]*@)?([^/@:]*\\.)?example\\.com([:/?#]|$)')",
    "user_info": "regexp_matches(url, '^[a-z]+://[^/]*@')", "fragment": "contains(url, '#')"}))
def p14(t):
    return C.expect_url_policy(t.pages, "page_id", "url", ["example.com"], suffix=True)


@query("p15_expect_job_fields", rules_sql("""(SELECT doc_id, 'shard_' || CAST(doc_id % 8 AS VARCHAR) AS job_id, n_chars * 3000000 AS b, doc_id % 9000 AS s, sha256(text) AS sha FROM documents)""", "doc_id", {
    "job_id": "doc_id % 8 = 7", "filename": "doc_id % 11 = 0", "bytes": "b <= 0 OR b > 11000000000", "sha256": "doc_id % 13 = 0", "time_budget": "s < 1 OR s > 7200", "same_endpoint": "doc_id % 17 = 0"}))
def p15(t):
    d = F.col("doc_id")
    jobs = t.documents.select(
        "doc_id", F.concat(F.lit("shard_"), (d % 8).cast("string")).alias("job_id"), F.when(d % 11 == 0, "other.bin").otherwise("archive.zip.bin").alias("filename"),
        (F.col("n_chars") * 3000000).alias("expected_bytes"), F.when(d % 13 == 0, F.upper(F.sha2("text", 256))).otherwise(F.sha2("text", 256)).alias("expected_sha256"),
        (d % 9000).alias("max_seconds"), F.lit("https://a/x").alias("read_url"), F.when(d % 17 == 0, "https://a/x").otherwise("https://a/y").alias("put_url"))
    return C.expect_job_fields(jobs, "doc_id", "archive.zip.bin")


@query("p16_bank_geometry", rules_sql("(SELECT study_id || '/' || CAST(slot AS VARCHAR) || '/' || CAST(k AS VARCHAR) AS key, CAST(study_id AS BIGINT) AS s, slot, k, CASE WHEN k = 3 AND slot = 1 THEN 1.5 ELSE position END AS position FROM fx_bank)", "key", {
    "width": "s % 5 = 0 AND k = 0", "non_finite": "s % 7 = 0 AND k = 1", "position_range": "position < 0 OR position > 1", "absent_position": "FALSE", "mask_series": "s % 3 = 0 AND slot = 2",
    "slot_range": "slot >= 5", "k_range": "FALSE"}))
def p16(t):
    s, k, slot = F.col("study_id").cast("bigint"), F.col("k"), F.col("slot")
    e = F.when((s % 5 == 0) & (k == 0), F.slice("embedding", 1, 63)).when((s % 7 == 0) & (k == 1), F.transform("embedding", lambda x: F.lit("nan").cast("float"))).otherwise(F.col("embedding"))
    broken = (R.bank(t).withColumn("embedding", e).withColumn("position", F.when((k == 3) & (slot == 1), 1.5).otherwise(F.col("position")))
              .withColumn("series_id", F.when((s % 3 == 0) & (slot == 2), "").otherwise(F.col("series_id"))))
    return C.bank_geometry(broken, width=64, k=4, slots=5)


@query("p17_freshness_gate", """SELECT event_id, coalesce(age BETWEEN 0 AND 900 AND required >= runtime + 1500 AND available >= required, FALSE) AS fresh
    FROM (SELECT event_id, CAST(event_id % 1000 AS DOUBLE) - 50 AS age, 1200.0 + value AS required, 300 AS runtime, CASE WHEN event_id % 9 <> 0 THEN 1500.0 + value * 2 ELSE NULL END AS available
          FROM (SELECT event_id, value * 10 AS value FROM events))""")
def p17(t):
    e, v = F.col("event_id"), F.col("value") * 10
    gate = t.events.select("event_id", (F.lit(10_000.0) - (e % 1000 - 50)).alias("observed"), (v + 1200).alias("required"), F.lit(300).alias("runtime"),
                           F.when(e % 9 != 0, v * 2 + 1500).alias("available"))
    return C.freshness_gate(gate, F.lit(10_000.0)).select("event_id", "fresh")


@query("p18_expect_history", """WITH h AS (SELECT l_orderkey AS run, l_linenumber AS epoch, CASE WHEN l_orderkey % 10 = 0 THEN l_linenumber * 5 + 1 ELSE l_linenumber * 5 END AS updates,
                                       CASE WHEN l_partkey % 50 = 0 THEN 'nan'::DOUBLE ELSE l_quantity END AS loss FROM lineitem),
    per AS (SELECT run, epoch, count(*) AS c, min(updates) AS u0, max(updates) AS u1, count(*) FILTER (isnan(loss)) AS bad FROM h GROUP BY ALL)
    SELECT CAST(o.o_orderkey AS VARCHAR) AS run_id, 2::BIGINT AS epochs, count(*) FILTER (epoch BETWEEN 1 AND 2 AND c = 1) = 2 AS epochs_ok,
           count(*) FILTER (u0 <> epoch * 5 OR u1 <> u0 OR epoch > 2) = 0 AS updates_ok, coalesce(sum(bad), 0) = 0 AS loss_ok
    FROM orders o LEFT JOIN per ON per.run = o.o_orderkey GROUP BY o.o_orderkey""")
def p18(t):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    history = t.lineitem.select(R.text("l_orderkey").alias("run_id"), n.alias("epoch"), F.when(k % 10 == 0, n * 5 + 1).otherwise(n * 5).alias("updates"),
                                F.when(F.col("l_partkey") % 50 == 0, S.dbl("nan")).otherwise(F.col("l_quantity")).alias("loss"))
    runs = t.orders.select(R.text("o_orderkey").alias("run_id"), F.lit(2).alias("epochs"), F.lit(33).alias("n"), F.lit(7).alias("batch"))
    return C.expect_history(history, runs)


# ---- keys and sets ----------------------------------------------------------

@query("j02_coverage_report", """WITH e AS (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders), a AS (SELECT CAST(l_orderkey AS VARCHAR) AS id FROM lineitem WHERE l_linenumber < 3 UNION ALL SELECT 'x' || CAST(doc_id AS VARCHAR) FROM labels),
    ec AS (SELECT id, count(*) AS c FROM e GROUP BY id), ac AS (SELECT id, count(*) AS c FROM a GROUP BY id), b AS (SELECT coalesce(ec.id, ac.id) AS id, ec.c AS e, ac.c AS a FROM ec FULL JOIN ac ON ec.id = ac.id)
    SELECT 'missing' AS rule, count(*) AS n_violations, min(id) AS sample_key FROM b WHERE a IS NULL UNION ALL SELECT 'unexpected', count(*), min(id) FROM b WHERE e IS NULL
    UNION ALL SELECT 'duplicate', count(*), min(id) FROM b WHERE e > 1 OR a > 1""")
def j02(t):
    actual = t.lineitem.filter("l_linenumber < 3").select(R.text("l_orderkey").alias("study_id"))
    extra = t.labels.select(F.concat(F.lit("x"), R.text("doc_id")).alias("study_id"))
    return C.coverage_report(R.studies(t), actual.unionByName(extra), ["study_id"])


@query("j02b_ordered_coverage", """WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS o FROM labels)
    SELECT 'missing' AS rule, count(*) FILTER (doc_id % 40 = 0) AS n_violations, min(CAST(doc_id AS VARCHAR)) FILTER (doc_id % 40 = 0) AS sample_key FROM s
    UNION ALL SELECT 'unexpected', 0, NULL UNION ALL SELECT 'duplicate', 0, NULL
    UNION ALL SELECT 'out_of_order', count(*), min(CAST(doc_id AS VARCHAR)) FROM s WHERE doc_id % 40 <> 0 AND doc_id % 25 = 0""")
def j02b(t):
    from ..operators.ordering import with_row_number
    saved = with_row_number(t.labels.select("doc_id"), [], [F.col("doc_id").asc()], "o")
    d = F.col("doc_id")
    other = saved.filter(d % 40 != 0).withColumn("o", F.when(d % 25 == 0, F.col("o") + 1).otherwise(F.col("o")))
    return C.coverage_report(saved, other, ["doc_id"], ordinal="o")


@query("j03_expect_disjoint", """SELECT 'overlap' AS rule, count(DISTINCT study_id) AS n_violations, min(study_id) AS sample_key FROM fx_roles WHERE role = 'gradient' AND CAST(study_id AS BIGINT) % 9 = 0""")
def j03(t):
    train = R.roles(t).filter("role = 'gradient'").select("study_id")
    leaked = R.roles(t).filter((F.col("role") == "holdout") | (F.col("study_id").cast("bigint") % 9 == 0)).select("study_id")
    return C.expect_disjoint(train, leaked, ["study_id"])


@query("j04_expect_mapping", rules_sql("fx_series", "series_id", {"mapping_differs": "shard = 6 AND n > 25"}))
def j04(t):
    parent = R.series(t).select("series_id", "study_id")
    moved = F.when((F.col("shard") == 6) & (F.col("n") > 25), F.concat(F.lit("z"), "study_id")).otherwise(F.col("study_id"))
    return C.expect_mapping(R.series(t).select("series_id", moved.alias("study_id")), parent, "series_id", "study_id")


@query("o01_sorted_ids", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders")
def o01(t):
    return C.sorted_ids(t.orders.select(R.text("o_custkey").alias("id")), "id")


@query("o02_union_shards", "SELECT CAST(l_partkey % 7 AS BIGINT) AS shard, count(*) AS n, count(DISTINCT l_orderkey) AS studies FROM lineitem GROUP BY 1")
def o02(t):
    s = t.lineitem.select(F.col("l_orderkey").alias("study_id"), "l_partkey")
    parts = {i: s.filter(F.col("l_partkey") % 7 == i).select("study_id") for i in range(7)}
    return SEL.union_shards(parts, set(range(7))).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("study_id").alias("studies"))


@query("o02b_expect_one_shard", rules_sql("(SELECT CAST(l_partkey AS VARCHAR) AS p, count(*) AS c FROM lineitem GROUP BY 1)", "p", {"repeated_across_shards": "c > 1"}))
def o02b(t):
    return SEL.expect_one_shard(t.lineitem.select(R.text("l_partkey").alias("series_id")))


@query("o03_set_relation", """WITH a AS (SELECT DISTINCT doc_id FROM labels), b AS (SELECT DISTINCT doc_id FROM documents)
    SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (doc_id)) AS n_both,
           (SELECT count(*) FROM a JOIN b USING (doc_id)) = (SELECT count(*) FROM a) AND (SELECT count(*) FROM a JOIN b USING (doc_id)) = (SELECT count(*) FROM b) AS equal,
           (SELECT count(*) FROM a JOIN b USING (doc_id)) = (SELECT count(*) FROM a) AS a_subset_b, (SELECT count(*) FROM a JOIN b USING (doc_id)) = 0 AS disjoint""")
def o03(t):
    return C.set_relation(t.labels.select("doc_id"), t.documents.select("doc_id"), ["doc_id"])


# ---- manifests --------------------------------------------------------------

@query("j06_reconcile", """WITH m AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_totalprice AS p FROM orders)
    SELECT 's' AS rule, count(*) FILTER (id % 20 = 0 AND s <> 'F') AS n_violations, min(CAST(id AS VARCHAR)) FILTER (id % 20 = 0 AND s <> 'F') AS sample_key FROM m
    UNION ALL SELECT 'p', count(*) FILTER (id % 30 = 0 OR id % 70 = 1), min(CAST(id AS VARCHAR)) FILTER (id % 30 = 0 OR id % 70 = 1) FROM m""")
def j06(t):
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    i = F.col("id")
    b = (a.withColumn("s", F.when(i % 20 == 0, "F").otherwise(F.col("s")))
         .withColumn("p", F.when(i % 30 == 0, F.lit(None)).when(i % 70 == 1, F.col("p") + 1).otherwise(F.col("p") * (1 + 1e-9))))
    return A.reconcile(a, b, ["id"], ["s"], ["p"])


@query("j07_manifest_join", """WITH b AS (SELECT m.doc_id, CAST(m.doc_id AS VARCHAR) AS key, m.sha, o.bytes AS ob, m.bytes AS mb, o.sha AS osha, m.doc_id % 29 = 3 AS odd FROM fx_manifest m JOIN fx_observed o USING (doc_id))
    SELECT 'missing' AS rule, count(*) AS n_violations, min(CAST(doc_id AS VARCHAR)) AS sample_key FROM fx_manifest WHERE doc_id NOT IN (SELECT doc_id FROM fx_observed)
    UNION ALL SELECT 'unexpected', 0, NULL UNION ALL SELECT 'duplicate', 0, NULL
    UNION ALL SELECT 'member_name', count(*), min(key) FROM b WHERE odd UNION ALL SELECT 'unsafe_path', count(*), min(key) FROM b WHERE odd
    UNION ALL SELECT 'logical_bytes', count(*), min(key) FROM b WHERE ob <> mb UNION ALL SELECT 'storage_bytes', count(*), min(key) FROM b WHERE mb // 2 <= 0
    UNION ALL SELECT 'digest_changed', count(*), min(key) FROM b WHERE sha <> osha UNION ALL SELECT 'sha_format', 0, NULL UNION ALL SELECT 'crc_format', 0, NULL""")
def j07(t):
    d = F.col("doc_id")
    obs = R.observed(t)
    docs = t.documents.select("doc_id", S.crc32_hex(F.col("text").cast("binary")).alias("crc32"))
    sha_after = obs.select("doc_id", F.col("sha").alias("sha_after"))
    m = (R.manifest(t).join(docs, "doc_id").join(sha_after, "doc_id", "left")
         .select("doc_id", F.when(d % 29 == 3, F.concat(F.lit("../"), "member")).otherwise(F.col("member")).alias("member"), F.col("bytes").alias("logical_bytes"),
                 F.floor(F.col("bytes") / 2).alias("storage_bytes"), F.col("sha").alias("sha_before"), "sha_after", "crc32"))
    return A.manifest_join(m, obs.select("doc_id", "bytes"), "doc_id", F.concat(F.lit("doc/"), R.text("doc_id"), F.lit(".txt")))

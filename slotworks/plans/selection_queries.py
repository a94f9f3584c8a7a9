"""Candidates, indices, plans, inventories."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalars as S
from ..operators import audit as A
from ..operators import selection as SEL
from . import roles as R
from .registry import query
from .role_sql import bits, r6, tree_sql, u


def ranked(t):
    return SEL.rank_candidates(SEL.usable_series(R.slotted(t)))


@query("j05_lookup_count", "SELECT study_id, series_id, CASE WHEN CAST(split_part(series_id, '-', 2) AS BIGINT) % 3 = 0 THEN 0 ELSE n END AS n FROM fx_series")
def j05(t):
    s = R.series(t)
    known = s.filter(F.split("series_id", "-")[1].cast("bigint") % 3 != 0)
    return SEL.lookup_count(s.select("study_id", "series_id"), known, "series_id").select("study_id", "series_id", "n")


@query("w01_rank_candidates", "SELECT study_id, slot, series_id, n, rank FROM fx_ranked")
def w01(t):
    return ranked(t).select("study_id", "slot", "series_id", "n", "rank")


@query("w01b_rank_candidates_legacy", """SELECT study_id, slot, series_id, row_number() OVER (PARTITION BY study_id, slot ORDER BY n DESC, CAST(split_part(series_id, '-', 2) AS BIGINT)) AS rank FROM fx_slotted WHERE n >= 3""")
def w01b(t):
    s = SEL.usable_series(R.slotted(t)).withColumn("ordinal", F.split("series_id", "-")[1].cast("bigint"))
    return SEL.rank_candidates(s, ordinal="ordinal").select("study_id", "slot", "series_id", "rank")


@query("w02_select_series", "SELECT study_id, slot, series_id, n, CAST(shard AS BIGINT) AS shard FROM fx_selected")
def w02(t):
    return R.selected(t)


@query("w02b_expect_every_study", """SELECT 'missing' AS rule, count(*) AS n_violations, min(id) AS sample_key FROM (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS id FROM orders) WHERE id NOT IN (SELECT study_id FROM fx_selected)
    UNION ALL SELECT 'unexpected', count(*), min(id) FROM (SELECT DISTINCT study_id AS id FROM fx_selected) WHERE id NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders)
    UNION ALL SELECT 'duplicate', 0, NULL""")
def w02b(t):
    return SEL.expect_every_study(R.studies(t), R.selected(t))


@query("w03_sample_candidate", f"""SELECT study_id, slot, series_id, n FROM (SELECT *, row_number() OVER (PARTITION BY study_id, slot
      ORDER BY {bits("'42:1:' || study_id || ':' || CAST(slot AS VARCHAR) || ':' || series_id")}, series_id) AS d FROM fx_slotted WHERE n >= 3) WHERE d = 1""")
def w03(t):
    return SEL.sample_candidate(SEL.usable_series(R.slotted(t)), 42, 1)


def listed(c):
    return F.array_join(S.col(c).cast("array<string>"), ",")


@query("w06_slice_indices", "SELECT study_id, slot, string_agg(CAST(slice_no AS VARCHAR), ',' ORDER BY k) AS idx FROM fx_plan GROUP BY ALL")
def w06(t):
    return SEL.with_indices(R.selected(t)).select("study_id", "slot", listed("idx").alias("idx"))


@query("w06b_slice_indices_one", "SELECT series_id, CAST(round_even(0.04::DOUBLE * (n - 1), 0) AS BIGINT) AS slice_no FROM fx_selected")
def w06b(t):
    return SEL.with_indices(R.selected(t), 1).select("series_id", F.explode("idx").alias("slice_no"))


CENTRES = """SELECT series_id, n, k, CAST(greatest(1, least(greatest(1, n - 2), round_even(CASE WHEN k = 7 THEN b ELSE k * ((b - a) / 7.0::DOUBLE) + a END, 0))) AS BIGINT) AS centre
    FROM (SELECT series_id, n, CASE WHEN b0 < a0 THEN (n - 1) / 2.0::DOUBLE ELSE a0 END AS a, CASE WHEN b0 < a0 THEN (n - 1) / 2.0::DOUBLE ELSE b0 END AS b
          FROM (SELECT series_id, n, greatest(1.0::DOUBLE, 0.04::DOUBLE * (n - 1)) AS a0, least(n - 2.0::DOUBLE, 0.96::DOUBLE * (n - 1)) AS b0 FROM fx_series)), (SELECT unnest(range(8)) AS k)"""


def centres(t):
    return R.series(t).select("series_id", "n", F.posexplode(G.window_centres("n", 8)).alias("k", "centre"))


@query("w07_window_centres", f"SELECT series_id, string_agg(CAST(centre AS VARCHAR), ',' ORDER BY k) AS centres FROM ({CENTRES}) GROUP BY series_id")
def w07(t):
    return R.series(t).select("series_id", listed(G.window_centres("n", 8)).alias("centres"))


@query("w07b_window_centres_jitter", f"""WITH ab AS (SELECT series_id, n, CASE WHEN b0 < a0 THEN (n - 1) / 2.0::DOUBLE ELSE a0 END AS a, CASE WHEN b0 < a0 THEN (n - 1) / 2.0::DOUBLE ELSE b0 END AS b
          FROM (SELECT series_id, n, greatest(1.0::DOUBLE, 0.04::DOUBLE * (n - 1)) AS a0, least(n - 2.0::DOUBLE, 0.96::DOUBLE * (n - 1)) AS b0 FROM fx_series)),
    cells AS (SELECT series_id, n, k, k * ((b - a) / 4.0::DOUBLE) + a AS e0, CASE WHEN k = 3 THEN b ELSE (k + 1) * ((b - a) / 4.0::DOUBLE) + a END AS e1 FROM ab, (SELECT unnest(range(4)) AS k))
    SELECT series_id, string_agg(CAST(CAST(greatest(1, least(greatest(1, n - 2), round_even(e0 + {u("'7:0:' || series_id || ':' || CAST(k AS VARCHAR)")} * (e1 - e0), 0))) AS BIGINT) AS VARCHAR), ',' ORDER BY k) AS centres
    FROM cells GROUP BY series_id""")
def w07b(t):
    jitter = lambda i: S.hash_uniform(F.lit(7), F.lit(0), F.col("series_id"), i)
    return R.series(t).select("series_id", listed(G.window_centres("n", 4, jitter=jitter)).alias("centres"))


@query("w08_neighbour_windows", f"""SELECT n, CAST(k AS BIGINT) AS k, CAST(c AS BIGINT) AS channel, greatest(0, least(n - 1, centre + c - 1)) AS slice_no, count(*) AS windows
    FROM ({CENTRES}), (SELECT unnest(range(3)) AS c) GROUP BY ALL""")
def w08(t):
    return SEL.neighbour_windows(centres(t)).groupBy("n", "k", "channel", "slice_no").agg(F.count(F.lit(1)).alias("windows"))


@query("w09_with_position", f"SELECT study_id, slot, CAST(k AS BIGINT) AS k, {r6('slice_no / CAST(n - 1 AS DOUBLE)')} AS position FROM fx_plan")
def w09(t):
    return SEL.plan_rows(R.selected(t)).select("study_id", "slot", "k", "position")


@query("w09b_with_position_legacy", f"SELECT n, CAST(k AS BIGINT) AS k, {r6('centre / CAST(greatest(n - 1, 1) AS DOUBLE)')} AS position, count(*) AS windows FROM ({CENTRES}) GROUP BY ALL")
def w09b(t):
    return SEL.with_position(centres(t), "centre", legacy=True).groupBy("n", "k", "position").agg(F.count(F.lit(1)).alias("windows"))


@query("j12_ownership", "SELECT study_id, slot, series_id, shard IN (0, 3) AS owned FROM fx_selected")
def j12(t):
    return SEL.ownership(R.selected(t), [0, 3]).select("study_id", "slot", "series_id", "owned")


LINES = """SELECT study_id, slot, study_id || ':' || CAST(slot AS VARCHAR) || ':' || series_id || ':' || CAST(shard AS VARCHAR) || ':' || string_agg(CAST(slice_no AS VARCHAR), ',' ORDER BY k) AS line
    FROM fx_plan GROUP BY study_id, slot, series_id, shard"""


@query("a35_plan_digest", tree_sql(f"SELECT line FROM ({LINES})"))
def a35(t):
    return A.plan_digest(SEL.plan_lines(R.selected(t)))


@query("a35c_plan_digest_sorted", f"SELECT 'sorted' AS scheme, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY study_id, slot)) AS digest FROM ({LINES})")
def a35c(t):
    return A.plan_digest(SEL.plan_lines(R.selected(t)), scheme="sorted")


@query("a35b_plan_summary", """SELECT (SELECT count(DISTINCT study_id) FROM fx_selected) AS studies, (SELECT count(*) FROM fx_series) AS series, (SELECT count(*) FROM fx_selected) AS selected_series,
    (SELECT count(*) * 4 FROM fx_selected) AS images""")
def a35b(t):
    return SEL.plan_summary(R.series(t), R.selected(t))


@query("a31_series_inventory", f"""WITH s AS (SELECT study_id, slot, count(*) AS c FROM fx_slotted GROUP BY ALL), p AS (SELECT study_id, sum(c)::DOUBLE AS v, max(c) AS most FROM s GROUP BY study_id)
    SELECT 'series_per_study_min' AS metric, {r6('min(v)')} AS value FROM p UNION ALL SELECT 'series_per_study_median', {r6('quantile_cont(v, 0.5)')} FROM p UNION ALL SELECT 'series_per_study_max', {r6('max(v)')} FROM p
    UNION ALL SELECT 'slices_per_series_min', {r6('min(n)')} FROM fx_series UNION ALL SELECT 'slices_per_series_median', {r6('quantile_cont(n::DOUBLE, 0.5)')} FROM fx_series UNION ALL SELECT 'slices_per_series_max', {r6('max(n)')} FROM fx_series
    UNION ALL SELECT 'repeated_slot_studies', {r6('count(*) FILTER (most > 1)')} FROM p UNION ALL SELECT 'studies', {r6('count(*)')} FROM p""")
def a31(t):
    return A.series_inventory(R.slotted(t))


@query("a32_flag_redundancy", f"""SELECT a, b, count(*) AS n, {r6('count(*)::DOUBLE / (SELECT count(*) FROM lineitem)')} AS share, {r6('(SELECT count(*) FROM lineitem WHERE (l_linestatus = chr(70)) = (l_returnflag <> chr(78)))::DOUBLE / (SELECT count(*) FROM lineitem)')} AS equal_share
    FROM (SELECT l_linestatus = 'F' AS a, l_returnflag <> 'N' AS b FROM lineitem) GROUP BY ALL""")
def a32(t):
    flags = t.lineitem.select((F.col("l_linestatus") == "F").alias("x"), (F.col("l_returnflag") != "N").alias("y"))
    return A.flag_redundancy(flags, "x", "y")


@query("a33_ids_digest", tree_sql("SELECT CAST(o_orderkey AS VARCHAR) AS line FROM orders"))
def a33(t):
    return A.ids_digest(t.orders, "o_orderkey")


@query("a33c_ids_digest_sorted", "SELECT 'sorted' AS scheme, count(*) AS n, sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY CAST(o_orderkey AS VARCHAR))) AS digest FROM orders")
def a33c(t):
    return A.ids_digest(t.orders, "o_orderkey", scheme="sorted")


@query("a33b_ids_digest_bucketed", tree_sql("SELECT series_id AS line FROM fx_series"))
def a33b(t):
    return A.ids_digest(R.series(t), "series_id", scheme="tree2")


@query("a34_table_digest", tree_sql("SELECT member || chr(9) || CAST(bytes AS VARCHAR) || chr(9) || sha AS line FROM fx_manifest"))
def a34(t):
    return A.table_digest(R.manifest(t), "member", "bytes", "sha")


@query("a34b_table_digest_sorted", "SELECT 'sorted' AS scheme, count(*) AS n, sha256(string_agg(member || chr(9) || CAST(bytes AS VARCHAR) || chr(9) || sha || chr(10), '' ORDER BY member)) AS digest FROM fx_manifest")
def a34b(t):
    return A.table_digest(R.manifest(t), "member", "bytes", "sha", scheme="sorted")


@query("a36_config_identity", """SELECT event_id, sha256('{"k":"' || (props ->> 'k') || '","type":"' || event_type || '","user":"' || CAST(user_id AS VARCHAR) || '"}') AS identity FROM events""")
def a36(t):
    config = F.create_map(F.lit("user"), R.text("user_id"), F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    return A.config_identity(t.events.select("event_id", config.alias("config")), "config").select("event_id", "identity")


@query("w13_latest_per_key", f"""SELECT user_id, event_type, event_id, {r6('value')} AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def w13(t):
    return A.latest_per_key(t.events.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")

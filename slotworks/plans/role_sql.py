"""The role mapping of the driver tables as SQL common table expressions."""
from __future__ import annotations


def u(expr: str) -> str:
    """Deterministic uniform of a text expression, as in functions.scalars."""
    return f"(CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def bits(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT)"


def bits60(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 15)) AS BIGINT)"


def tree_sql(lines: str) -> str:
    """The two-level digest of a subquery with the column `line`."""
    joined = "sha256(string_agg({0}, chr(10) ORDER BY {0}))"
    node = joined.format("b || chr(9) || d")
    return f"""WITH once AS (SELECT coalesce(line, '') AS t, count(*) AS c FROM ({lines}) GROUP BY 1),
    leaf AS (SELECT substr(sha256(t), 1, 6) AS b, sum(c) AS n, {joined.format("CASE WHEN c = 1 THEN t ELSE t || chr(9) || '*' || c END")} AS d FROM once GROUP BY 1),
    mid AS (SELECT substr(b, 1, 3) AS b, sum(n) AS n, {node} AS d FROM leaf GROUP BY 1)
    SELECT 'tree2' AS scheme, CAST(sum(n) AS BIGINT) AS n, {node} AS digest FROM mid"""


def r6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE) + 1e-9::DOUBLE, 6) + 0.0::DOUBLE)"


def rules_sql(source: str, key: str, rules: dict[str, str]) -> str:
    """One row per rule: violations and the smallest violating key."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS rule, CAST(count(*) AS BIGINT) AS n_violations, min(CAST({key} AS VARCHAR)) AS sample_key FROM {source} WHERE {cond}"
        for name, cond in rules.items())


LABELS3 = "(VALUES ('quality'), ('toxic'), ('english')) AS l(label)"

ROLES: dict[str, str] = {
    "fx_series": """
        SELECT CAST(l_orderkey AS VARCHAR) AS study_id,
               CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS series_id,
               l_returnflag AS plane, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS fat_sup,
               CAST(l_quantity AS BIGINT) AS n, CAST(l_partkey % 7 AS BIGINT) AS shard
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC,
                     l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem)
        WHERE rn = 1""",
    "fx_slotted": """
        SELECT *, CAST(CASE plane WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END + 3 * (1 - fat_sup) AS BIGINT) AS slot FROM fx_series""",
    "fx_ranked": """
        SELECT *, row_number() OVER (PARTITION BY study_id, slot ORDER BY n DESC, series_id) AS rank FROM fx_slotted WHERE n >= 3""",
    "fx_selected": "SELECT study_id, slot, series_id, n, shard FROM fx_ranked WHERE rank = 1",
    "fx_plan": """
        SELECT study_id, slot, series_id, shard, n, k, greatest(0, least(n - 1, CAST(round_even(
                 CASE WHEN k = 3 THEN 0.96::DOUBLE * (n - 1)
                      ELSE k * ((0.96::DOUBLE * (n - 1) - 0.04::DOUBLE * (n - 1)) / 3.0::DOUBLE) + 0.04::DOUBLE * (n - 1) END, 0) AS BIGINT))) AS slice_no
        FROM fx_selected, (VALUES (0), (1), (2), (3)) AS v(k)""",
    "fx_official": """
        SELECT CAST(d.doc_id AS VARCHAR) AS study_id, CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic,
               CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN d.lang = 'en' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS english
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "fx_truth": """
        SELECT study_id, 'quality' AS label, CAST(quality AS BIGINT) AS y FROM fx_official WHERE quality IS NOT NULL
        UNION ALL SELECT study_id, 'toxic', CAST(toxic AS BIGINT) FROM fx_official WHERE quality IS NOT NULL
        UNION ALL SELECT study_id, 'english', CAST(english AS BIGINT) FROM fx_official WHERE quality IS NOT NULL""",
    "fx_sources": f"""
        SELECT source, CAST(doc_id AS VARCHAR) AS study_id, label,
               CASE WHEN {u("'null:' || source || ':' || label || ':' || CAST(doc_id AS VARCHAR)")} < 0.15 THEN NULL
                    ELSE round({u("source || ':' || label || ':' || CAST(doc_id AS VARCHAR)")}, 4) END AS p
        FROM (SELECT doc_id FROM documents), (VALUES ('s0'), ('s1'), ('s2'), ('s3')) AS s(source), {LABELS3}""",
    "fx_soft": """
        SELECT study_id, label, CASE WHEN den > 0 THEN least(0.99::DOUBLE, greatest(0.01::DOUBLE, num / den)) END AS p
        FROM (SELECT study_id, label, sum(CASE WHEN source = 's3' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * p) AS num,
                     sum(CASE WHEN p IS NOT NULL THEN CASE WHEN source = 's3' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END END) AS den
              FROM fx_sources GROUP BY ALL)""",
    "fx_grades": f"""
        SELECT CAST(doc_id AS VARCHAR) AS study_id, label,
               CAST(floor(5 * {u("'grade:' || label || ':' || CAST(doc_id AS VARCHAR)")}) AS BIGINT) - 1 AS grade
        FROM (SELECT doc_id FROM documents), (VALUES ('Effusion'), ('Synovitis'), ('ACL')) AS l(label)""",
    "fx_predictions": f"""
        SELECT 'a' AS model, study_id, label, round(0.6::DOUBLE * {u("'a:' || label || ':' || study_id")} + 0.4::DOUBLE * y, 3) AS score, y FROM fx_truth
        UNION ALL
        SELECT 'b', study_id, label, round(0.8::DOUBLE * {u("'b:' || label || ':' || study_id")} + 0.2::DOUBLE * y, 3), y FROM fx_truth""",
    "fx_roles": f"""
        SELECT study_id, CASE WHEN quality IS NOT NULL THEN 'gold' WHEN {bits("'fold:' || study_id")} % 5 = 0 THEN 'holdout' ELSE 'gradient' END AS role,
               quality IS NOT NULL AS is_gold, CASE WHEN quality IS NOT NULL THEN -1 ELSE {bits("'fold:' || study_id")} % 5 END AS fold
        FROM fx_official""",
    "fx_bank": """
        SELECT CAST(vec_id // 20 AS VARCHAR) AS study_id, (vec_id // 20 + 1 + (vec_id % 20) // 4) % 6 AS slot, vec_id % 4 AS k, CAST((vec_id % 4) / 3.0::DOUBLE AS FLOAT) AS position,
               vec_id // 20 AS sno, embedding, CAST(label AS BIGINT) AS target FROM embeddings""",
    "fx_dims": """
        SELECT study_id, slot, k, position, target, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM fx_bank""",
    "fx_pooled": "SELECT study_id, slot, dim, avg(x) AS x FROM fx_dims GROUP BY ALL",
    "fx_bank_plan": """
        SELECT study_id, slot, k, study_id || '-' || CAST(slot AS VARCHAR) AS series_id, (sno + slot) % 7 AS shard, position FROM fx_bank""",
    "fx_partials": """
        SELECT study_id, slot, k, series_id, CAST(shard AS BIGINT) AS shard,
               CASE WHEN CAST(study_id AS BIGINT) % 10 = 3 AND k = 2 THEN CAST(0.5 AS FLOAT) ELSE position END AS position, 'bank-v1' AS identity
        FROM fx_bank_plan WHERE NOT (shard = 6 AND CAST(study_id AS BIGINT) % 2 = 0)
        UNION ALL
        SELECT study_id, slot, k, series_id, (shard + 1) % 7, position, 'bank-v0' FROM fx_bank_plan WHERE CAST(study_id AS BIGINT) % 4 = 1 AND slot = 2""",
    "fx_headers": """
        SELECT CAST(user_id AS VARCHAR) AS series_id, event_id AS ordinal, event_id % 3 AS frame, CAST(event_id % 97 AS DOUBLE) AS instance,
               CASE WHEN user_id % 11 = 0 OR event_id % 17 = 0 THEN NULL ELSE [
                 CASE WHEN ra = 0 THEN sr WHEN ra <> 0 AND ca <> 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END,
                 CASE WHEN ra = 1 THEN sr WHEN ra <> 1 AND ca <> 1 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END,
                 CASE WHEN ra = 2 THEN sr WHEN ra <> 2 AND ca <> 2 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END,
                 CASE WHEN ca = 0 THEN sc WHEN ra <> 0 AND ca <> 0 THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END,
                 CASE WHEN ca = 1 THEN sc WHEN ra <> 1 AND ca <> 1 THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END,
                 CASE WHEN ca = 2 THEN sc WHEN ra <> 2 AND ca <> 2 THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END] END AS o,
               CASE WHEN user_id % 13 = 0 AND event_id % 7 = 0 THEN NULL ELSE [value, value * 0.5::DOUBLE, -value * 2.0::DOUBLE] END AS ipp,
               CASE WHEN user_id % 2 = 0 THEN 'Axial' END AS plane_name, value,
               CASE WHEN event_id % 19 <> 0 THEN 0.25::DOUBLE + (event_id % 7) / 10.0::DOUBLE END AS sp0,
               CASE WHEN event_id % 19 <> 0 THEN 0.3::DOUBLE + (event_id % 5) / 10.0::DOUBLE END AS sp1,
               200 + (event_id % 13) * 24 AS h, 220 + (event_id % 11) * 30 AS w
        FROM (SELECT *, user_id % 6 AS oi,
                     CASE user_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 2 END AS ra,
                     CASE user_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 0 ELSE 1 END AS ca,
                     CASE WHEN (user_id // 6) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sr,
                     CASE WHEN (user_id // 12) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sc FROM events)""",
    "fx_frame": """
        SELECT series_id, all_pos, n_slices, nrm, CASE WHEN nrm IS NULL THEN CASE plane_name WHEN 'Coronal' THEN 1 WHEN 'Axial' THEN 2 ELSE 0 END
                 ELSE list_position(list_transform(nrm, lambda x: abs(x)), list_max(list_transform(nrm, lambda x: abs(x)))) - 1 END AS plane
        FROM (SELECT *, CASE WHEN o IS NOT NULL THEN [o[2]*o[6]-o[3]*o[5], o[3]*o[4]-o[1]*o[6], o[1]*o[5]-o[2]*o[4]] END AS nrm
              FROM (SELECT series_id, arg_min(o, ordinal) FILTER (o IS NOT NULL) AS o, bool_and(ipp IS NOT NULL) AS all_pos, min(plane_name) AS plane_name,
                           count(*) AS n_slices FROM fx_headers GROUP BY series_id))""",
    "fx_ordered": """
        SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY key, ordinal) - 1 AS slice_no
        FROM (SELECT h.*, f.plane, f.n_slices, CASE WHEN f.nrm IS NOT NULL AND f.all_pos THEN h.ipp[1]*f.nrm[1] + h.ipp[2]*f.nrm[2] + h.ipp[3]*f.nrm[3] END AS along,
                     CASE WHEN f.nrm IS NOT NULL AND f.all_pos THEN (h.ipp[1]*f.nrm[1] + h.ipp[2]*f.nrm[2] + h.ipp[3]*f.nrm[3])
                               * (CASE WHEN f.plane = 2 THEN -1 ELSE 1 END * sign(f.nrm[f.plane + 1]))
                          ELSE h.instance + h.frame * 0.001::DOUBLE END AS key
              FROM fx_headers h JOIN fx_frame f USING (series_id))""",
    "fx_pixels": """
        SELECT CAST(user_id AS VARCHAR) AS series_id, event_id % 16 AS "row", (event_id // 16) % 16 AS "col", avg(value) AS value FROM events GROUP BY ALL""",
    "fx_receipts": """
        SELECT event_id AS step, CAST(user_id AS VARCHAR) AS job, ts, CAST(props ->> 'k' AS BIGINT) AS images, CAST(floor(value * 1000000) AS BIGINT) AS bytes,
               coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) / 1000000.0::DOUBLE AS seconds, user_id % 7 AS shard
        FROM events""",
    "fx_manifest": """
        SELECT doc_id, 'doc/' || CAST(doc_id AS VARCHAR) || '.txt' AS member, octet_length(encode(text)) AS bytes, sha256(text) AS sha FROM documents""",
    "fx_observed": """
        SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN bytes + 1 ELSE bytes END AS bytes,
               CASE WHEN doc_id % 100 = 0 THEN substr(sha, 1, 60) ELSE sha END AS sha FROM fx_manifest WHERE doc_id % 97 <> 5""",
}

"""Weak labels, report groups and folds."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.text import report_key
from ..operators import labels as L
from ..session import spread
from . import roles as R
from .registry import query
from .role_sql import r6

# Per-group AUC in plain SQL: wins over ties, from a window over distinct scores.
AUC_SQL = """SELECT {by}, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
       sum(pos * (below + neg / 2.0::DOUBLE)) / nullif(sum(pos) * sum(neg), 0) AS auc
  FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT {by}, score, CAST(sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS DOUBLE) AS pos, CAST(sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS DOUBLE) AS neg
              FROM ({rows}) GROUP BY {by}, score)) GROUP BY {by}"""


def auc_sql(rows: str, by: str) -> str:
    return AUC_SQL.format(rows=rows, by=by)


@query("j01_align_to_spine", f"SELECT CAST(o.o_orderkey AS VARCHAR) AS study_id, s.series_id, s.n FROM orders o LEFT JOIN (SELECT * FROM fx_series WHERE n > 45) s ON s.study_id = CAST(o.o_orderkey AS VARCHAR)")
def j01(t):
    deep = R.series(t).filter("n > 45").select("study_id", "series_id", "n")
    extra = t.labels.select(F.concat(F.lit("not-in-spine-"), R.text("doc_id")).alias("study_id"), F.lit("x").alias("series_id"), F.lit(64).cast("bigint").alias("n"))
    return L.align_to_spine(R.studies(t), deep.unionByName(extra), ["study_id"])


@query("a01_consensus", f"SELECT study_id, label, {r6('p')} AS p FROM fx_soft")
def a01(t):
    return R.soft(t)


@query("a01b_consensus_drop_source", f"""SELECT study_id, label, {r6('CASE WHEN den > 0 THEN least(0.99::DOUBLE, greatest(0.01::DOUBLE, num / den)) END')} AS p
    FROM (SELECT study_id, label, sum(p) FILTER (source <> 's1') AS num, count(p) FILTER (source <> 's1') AS den FROM fx_sources GROUP BY ALL)""")
def a01b(t):
    return L.consensus(R.sources(t), {"s1": 0.0})


@query("a02_source_auc", f"""WITH voices AS (SELECT source, study_id, label, p FROM fx_sources UNION ALL SELECT 'consensus', study_id, label, p FROM fx_soft),
    asked AS (SELECT s.source, g.label, coalesce(v.p, 0.5) AS score, g.y, 1 AS w FROM fx_truth g CROSS JOIN (VALUES ('s0'), ('s1'), ('s2'), ('s3'), ('consensus')) AS s(source)
              LEFT JOIN voices v ON v.source = s.source AND v.study_id = g.study_id AND v.label = g.label),
    per AS ({auc_sql('SELECT * FROM asked', 'source, label')})
    SELECT source, label, {r6('auc')} AS auc FROM per UNION ALL SELECT source, 'MEAN', {r6('avg(auc)')} FROM per GROUP BY source""")
def a02(t):
    return L.source_auc(R.sources(t), R.truth(t), R.SOURCES, R.WEIGHTS)


@query("a03_label_summary", f"""SELECT label, count(p) AS n, {r6('avg(p)')} AS mean_p, {r6('avg(CASE WHEN p >= 0.5 THEN 1.0::DOUBLE WHEN p < 0.5 THEN 0.0::DOUBLE END)')} AS positive_fraction FROM fx_soft GROUP BY label""")
def a03(t):
    return L.label_summary(R.soft(t))


@query("a03b_fold_sizes", "SELECT CAST(fold AS BIGINT) AS fold, count(*) AS n FROM fx_roles GROUP BY fold")
def a03b(t):
    return L.fold_sizes(R.roles(t))


@query("a29_source_disagreement", f"""SELECT label, count(*) AS n, {r6('avg(CASE WHEN lo < 0.5 AND hi >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS differ_share,
    {r6('avg(CASE WHEN lo <= 0.25 AND hi >= 0.75 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS conflict_share, {r6('avg(hi - lo)')} AS mean_spread
    FROM (SELECT study_id, label, min(p) AS lo, max(p) AS hi FROM fx_sources GROUP BY ALL) WHERE lo IS NOT NULL GROUP BY label""")
def a29(t):
    return L.source_disagreement(R.sources(t))


@query("a30_silence_rate", f"SELECT source, label, {r6('avg(CASE WHEN p IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS silence FROM fx_sources GROUP BY ALL")
def a30(t):
    return L.silence_rate(R.sources(t))


KEY_SQL = "regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '', 'g')"


@query("f05_report_key", f"SELECT CAST(doc_id AS VARCHAR) AS study_id, {KEY_SQL} AS report_key FROM documents")
def f05(t):
    docs = spread(t.documents.select("doc_id", "text"), "doc_id")
    return docs.select(R.text("doc_id").alias("study_id"), report_key("text").alias("report_key"))


@query("a27_report_groups", f"""SELECT report_key, count(*) AS n_rows FROM (SELECT sha256({KEY_SQL}) AS report_key FROM documents) GROUP BY 1""")
def a27(t):
    return L.report_groups(t.documents.select("doc_id", "text"), "text")


@query("a27b_report_group_counts", f"""SELECT count(*) AS groups, count(*) FILTER (n > 1) AS repeated_groups, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_repeated
    FROM (SELECT {KEY_SQL} AS k, count(*) AS n FROM documents GROUP BY 1)""")
def a27b(t):
    return L.report_group_counts(L.report_groups(t.documents.select("doc_id", "text"), "text"))


@query("a28_near_template_groups", r"""WITH RECURSIVE tokens AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM documents),
    shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM tokens),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE shared.n >= 0.6::DOUBLE * (x.n + y.n - shared.n)),
    reach AS (SELECT doc_id AS node, doc_id AS far FROM documents UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.far)
    SELECT node AS doc_id, min(far) AS template FROM reach GROUP BY node""")
def a28(t):
    return L.near_template_groups(t.documents, "doc_id", "text")


@query("f03_grade_to_probability", f"""SELECT study_id, label, grade, {r6('''CASE label
      WHEN 'Effusion' THEN [0.25, 0.05, 0.35, 0.85, 0.97][grade + 2] WHEN 'Synovitis' THEN [0.30, 0.10, 0.55, 0.85, 0.95][grade + 2] ELSE [0.10, 0.03, 0.20, 0.70, 0.97][grade + 2] END''')} AS p FROM fx_grades""")
def f03(t):
    return L.grade_to_probability(R.grades(t))


@query("f04_conditional_override", f"""SELECT s.study_id, {r6('''CASE WHEN s.grade = -1 AND e.grade = 2 THEN 0.45 WHEN s.grade = -1 AND e.grade = 3 THEN 0.60 WHEN s.grade = -1 AND e.grade = 0 THEN 0.15
      ELSE [0.30, 0.10, 0.55, 0.85, 0.95][s.grade + 2] END''')} AS p FROM fx_grades s JOIN fx_grades e ON e.study_id = s.study_id AND e.label = 'Effusion' WHERE s.label = 'Synovitis'""")
def f04(t):
    done = L.conditional_override(L.grade_to_probability(R.grades(t)))
    return done.filter("label = 'Synovitis'").select("study_id", "p")


@query("w14_group_folds", f"""WITH RECURSIVE sizes AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n DESC) AS i, n FROM (SELECT count(*) AS n FROM documents GROUP BY {KEY_SQL})),
    walk AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads UNION ALL
             SELECT w.i + 1, list_transform(w.loads, lambda x, j: CASE WHEN j = list_position(w.loads, list_min(w.loads)) THEN x + s.n ELSE x END)
             FROM walk w JOIN sizes s ON s.i = w.i + 1)
    SELECT CAST(f AS BIGINT) AS fold, loads[f + 1] AS n, 0::BIGINT AS split_groups FROM (SELECT loads FROM walk ORDER BY i DESC LIMIT 1), (SELECT unnest(range(5)) AS f)""")
def w14(t):
    folded = L.group_folds(L.with_report_key(t.documents.select("doc_id", "text"), "text").select("doc_id", "report_key"), "report_key")
    split = folded.groupBy("report_key").agg(F.min("fold").alias("a"), F.max("fold").alias("b"))
    n_split = split.agg(F.count_if(F.col("a") != F.col("b")).alias("split_groups")).withColumn("_j", F.lit(1))
    sizes = L.fold_sizes(folded).withColumn("_j", F.lit(1))
    return sizes.join(F.broadcast(n_split), "_j").drop("_j")


@query("w14c_leak_free_roles", f"""WITH k AS (SELECT CAST(doc_id AS VARCHAR) AS study_id, sha256({KEY_SQL}) AS report_key FROM documents),
    r AS (SELECT k.report_key, o.quality IS NOT NULL AS gold FROM k JOIN fx_official o USING (study_id)), g AS (SELECT DISTINCT report_key FROM r WHERE gold)
    SELECT 0::BIGINT AS keys_in_two_roles, count(*) FILTER (gold) AS gold, count(*) FILTER (NOT gold AND report_key IN (SELECT report_key FROM g)) AS excluded,
           count(*) FILTER (NOT gold AND report_key NOT IN (SELECT report_key FROM g)) AS weak FROM r""")
def w14c(t):
    rows = R.report_roles(t)
    part = F.when(F.col("role") == "invalid", F.lit(None)).otherwise(F.col("role"))
    two = rows.groupBy("report_key").agg((F.min(part) != F.max(part)).alias("two")).agg(F.count_if("two").alias("keys_in_two_roles")).withColumn("_j", F.lit(1))
    counts = rows.agg(F.count_if("is_gold").alias("gold"), F.count_if(F.col("role") == "invalid").alias("excluded"),
                      F.count_if(F.col("role").isin("holdout", "gradient")).alias("weak")).withColumn("_j", F.lit(1))
    return two.join(counts, "_j").drop("_j")

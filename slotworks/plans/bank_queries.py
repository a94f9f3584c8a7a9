"""Pooling, statistics, duplicates, merge and resume."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bank as B
from ..operators import checks as C
from ..operators import models as M
from ..operators.ordering import exact_quantiles
from . import roles as R
from .registry import query
from .role_sql import bits, r6, rules_sql


def quantiles_sql(value: str) -> str:
    at = {"q_min": "0.0", "q05": "0.05", "median": "0.5", "q95": "0.95", "q_max": "1.0"}
    return ", ".join(f"{r6(f'quantile_cont({value}, {q}::DOUBLE)')} AS {n}" for n, q in at.items())


@query("a16_slot_mean_pool", f"SELECT study_id, slot, dim, {r6('x')} AS pooled FROM fx_pooled")
def a16(t):
    return B.explode_dims(B.slot_mean_pool(R.bank(t)), ["study_id", "slot"], {"pooled": "pooled"})


@query("a17_meanmax_pool", f"SELECT study_id, dim, {r6('avg(x)')} AS mean, {r6('max(x)')} AS max FROM fx_dims GROUP BY ALL")
def a17(t):
    return B.explode_dims(B.meanmax_pool(R.bank(t)), ["study_id"], {"mean": "mean", "max": "max"})


def scored(t):
    """Class scores from two dimensions of each vector."""
    e = lambda i: F.col("embedding")[i].cast("double") * 10
    return R.bank(t).withColumn("c0", e(0)).withColumn("c1", e(1) - e(2))


@query("a18_attention_pool", f"""WITH s AS (SELECT study_id, slot, k, 'c0' AS class, embedding[1]::DOUBLE * 10 AS s FROM fx_bank UNION ALL SELECT study_id, slot, k, 'c1', embedding[2]::DOUBLE * 10 - embedding[3]::DOUBLE * 10 FROM fx_bank),
    w AS (SELECT study_id, slot, k, class, exp(s - max(s) OVER (PARTITION BY study_id, class)) AS e FROM s)
    SELECT study_id, class, dim, {r6('sum(e * x) / sum(e)')} AS pooled FROM w JOIN fx_dims USING (study_id, slot, k) GROUP BY ALL""")
def a18(t):
    return B.explode_dims(B.attention_pool(scored(t), ["c0", "c1"], R.bank(t).select("study_id")), ["study_id", "class"], {"pooled": "pooled"})


@query("a18b_attention_pool_uniform", f"""SELECT CAST(i AS VARCHAR) AS study_id, {r6('CASE WHEN i IN (SELECT CAST(study_id AS BIGINT) FROM fx_bank) THEN 1 ELSE 0 END')} AS present FROM (SELECT DISTINCT vec_id AS i FROM embeddings)""")
def a18b(t):
    spine = t.embeddings.select(R.text("vec_id").alias("study_id"))
    pooled = B.attention_pool(scored(t), ["c0"], spine, R.WIDTH)
    return pooled.select("study_id", F.exists("pooled", lambda x: x != 0).cast("double").alias("present"))


FIT = "CAST(study_id AS BIGINT) % 3 <> 0"


def fit_ids(t):
    return R.bank(t).select("study_id").distinct().filter(F.col("study_id").cast("bigint") % 3 != 0)


STATS_SQL = f"""SELECT slot, dim, count(*) AS n, avg(x) AS mean, greatest(stddev_pop(x), 0.001::DOUBLE) AS std FROM fx_pooled WHERE {FIT} GROUP BY slot, dim"""


@query("a19_slot_stats", f"""SELECT s.slot, d.dim, coalesce(st.n, 0) AS n, {r6('coalesce(st.mean, 0)')} AS mean, {r6('coalesce(st.std, 0.001)')} AS std
    FROM (SELECT unnest(range(7)) AS slot) s CROSS JOIN (SELECT unnest(range(64)) AS dim) d LEFT JOIN ({STATS_SQL}) st ON st.slot = s.slot AND st.dim = d.dim""")
def a19(t):
    stats = B.slot_stats(B.slot_mean_pool(R.bank(t)), fit_ids(t), R.WIDTH, slots=7)
    return B.explode_dims(stats, ["slot", "n"], {"mean": "mean", "std": "std"})


@query("a20_bank_summary", """SELECT count(DISTINCT study_id) AS studies, count(DISTINCT (study_id, slot)) AS selected_slots, count(*) AS images,
    count(*) - count(DISTINCT (study_id, slot, k)) AS duplicates FROM fx_partials""")
def a20(t):
    return B.bank_summary(R.partials(t))


@query("a21_mask_patterns", """WITH b AS (SELECT study_id, string_agg(CASE WHEN hit THEN '1' ELSE '0' END, '' ORDER BY s) AS key FROM (SELECT st.study_id, s, count(fx.slot) > 0 AS hit
      FROM (SELECT DISTINCT study_id FROM fx_bank) st CROSS JOIN (SELECT unnest(range(6)) AS s) LEFT JOIN fx_bank fx ON fx.study_id = st.study_id AND fx.slot = s GROUP BY ALL) GROUP BY study_id)
    SELECT 'pattern' AS kind, key, count(*) AS n FROM b GROUP BY key UNION ALL SELECT 'slot', CAST(slot AS VARCHAR), count(DISTINCT study_id) FROM fx_bank GROUP BY slot
    UNION ALL SELECT 'slots_per_study', CAST(length(replace(key, '0', '')) AS VARCHAR), count(*) FROM b GROUP BY 2""")
def a21(t):
    return B.mask_patterns(R.bank(t))


NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


@query("a22_norm_stats", f"""WITH q AS (SELECT {quantiles_sql('nrm')} FROM (SELECT {NORM} AS nrm FROM fx_bank))
    SELECT metric, value FROM (UNPIVOT q ON q_min, q05, median, q95, q_max INTO NAME metric VALUE value) UNION ALL SELECT 'zero_vectors', {r6(f'count(*) FILTER ({NORM} = 0)')} FROM fx_bank
    UNION ALL SELECT 'max_abs', {r6('max(abs(x))')} FROM fx_dims""")
def a22(t):
    return B.norm_stats(R.bank(t))


@query("a23_dim_std_stats", f"""WITH m AS (SELECT study_id, dim, avg(x) AS x FROM fx_dims GROUP BY ALL),
    s AS (SELECT 'all' AS scope, -1 AS slot, stddev_pop(x) AS sd FROM fx_dims GROUP BY dim UNION ALL SELECT 'slot', slot, stddev_pop(x) FROM fx_dims GROUP BY slot, dim UNION ALL SELECT 'study_mean', -1, stddev_pop(x) FROM m GROUP BY dim)
    SELECT scope, CAST(slot AS BIGINT) AS slot, {quantiles_sql('sd')}, count(*) FILTER (sd = 0) AS constant_dims FROM s GROUP BY scope, slot""")
def a23(t):
    return B.dim_std_stats(R.bank(t))


def pairs_sql(ids: str, by: str, source: str, vector: str, limit: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    key = bits("'20261007:' || " + " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in ids.split(",")))
    by_out = by or "-1"
    return f"""SELECT a.grp AS slot, list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) AS c
      FROM (SELECT {by_out} AS grp, {vector} AS v, row_number() OVER ({part} ORDER BY {key}, {ids}) - 1 AS o FROM {source}) a
      JOIN (SELECT {by_out} AS grp, {vector} AS v, row_number() OVER ({part} ORDER BY {key}, {ids}) - 1 AS o FROM {source}) b
        ON b.grp = a.grp AND b.o = a.o + 1 AND a.o % 2 = 0 {limit}"""


@query("a24_cosine_sample", f"""WITH sm AS (SELECT study_id, list(m ORDER BY dim) AS v FROM (SELECT study_id, dim, avg(x) AS m FROM fx_dims GROUP BY ALL) GROUP BY study_id),
    c AS (SELECT 'cross_slice' AS scope, slot, c FROM ({pairs_sql('study_id,slot,k', '', 'fx_bank', 'embedding', 'AND a.o // 2 < 100')}) UNION ALL SELECT 'same_slot', slot, c FROM ({pairs_sql('study_id,slot,k', 'slot', 'fx_bank', 'embedding', 'AND a.o // 2 < 100')})
          UNION ALL SELECT 'study_pair', slot, c FROM ({pairs_sql('study_id', '', 'sm', 'v', '')}))
    SELECT scope, CAST(slot AS BIGINT) AS slot, {quantiles_sql('c')}, count(*) AS n_values FROM c GROUP BY scope, slot""")
def a24(t):
    return B.cosine_sample(R.bank(t), pairs=100)


@query("a25_covariance_spectrum")
def a25(t):
    return M.covariance_spectrum(R.bank(t), R.WIDTH)


@query("a25b_covariance_spectrum_plane", f"""WITH p AS (SELECT slot, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM fx_bank),
    s AS (SELECT 'all' AS scope, -1 AS slot, x, y FROM p UNION ALL SELECT 'slot', slot, x, y FROM p),
    m AS (SELECT scope, slot, count(*) AS n, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM s GROUP BY ALL),
    v AS (SELECT scope, slot, n, 0.5 + sqrt((a - b) * (a - b) / 4 + c * c) / (a + b) AS top FROM m)
    SELECT scope, slot, n, {r6('top')} AS top1, 1.0::DOUBLE AS top10, {r6('exp(-(top * ln(top) + (1 - top) * ln(1 - top)))')} AS effective_rank FROM v""")
def a25b(t):
    """The same over the first two numbers of every vector, whose spectrum has a closed form."""
    return M.covariance_spectrum(R.bank(t).withColumn("embedding", F.slice("embedding", 1, 2)), 2)


@query("a26_vector_duplicates", """WITH v AS (SELECT embedding AS e FROM embeddings UNION ALL SELECT embedding FROM embeddings WHERE vec_id % 7 = 0), g AS (SELECT e, count(*) AS c FROM v GROUP BY e)
    SELECT count(*) AS distinct_vectors, count(*) FILTER (c > 1) AS duplicate_groups, CAST(coalesce(sum(c) FILTER (c > 1), 0) AS BIGINT) AS rows_in_groups FROM g""")
def a26(t):
    e = t.embeddings.select("vec_id", "embedding")
    return B.vector_duplicates(e.unionByName(e.filter("vec_id % 7 = 0")))


@query("w17_consecutive_cosine", f"""SELECT {quantiles_sql('c')}, count(*) AS n_values FROM (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c
    FROM fx_bank a JOIN fx_bank b ON b.study_id = a.study_id AND b.slot = a.slot AND b.k = a.k + 1)""")
def w17(t):
    return exact_quantiles(B.consecutive_cosine(R.bank(t)), [], "cosine", B.FIVE)


# ---- merge and resume ---------------------------------------------------------

@query("j09_merge_rules", """WITH p AS (SELECT study_id, slot, k, count(*) AS c, min(shard) AS s0, max(shard) AS s1, min(position) AS p0, max(position) AS p1, count(*) FILTER (identity <> 'bank-v1') AS other FROM fx_partials GROUP BY ALL),
    b AS (SELECT coalesce(w.study_id, p.study_id) || '/' || CAST(coalesce(w.slot, p.slot) AS VARCHAR) || '/' || CAST(coalesce(w.k, p.k) AS VARCHAR) AS key, w.study_id IS NOT NULL AS planned, p.c, p.s0, p.s1, p.p0, p.p1, p.other, w.shard, w.position
          FROM fx_bank_plan w FULL JOIN p ON p.study_id = w.study_id AND p.slot = w.slot AND p.k = w.k)
    SELECT 'missing' AS rule, count(*) AS n_violations, min(key) AS sample_key FROM b WHERE c IS NULL UNION ALL SELECT 'unexpected', count(*), min(key) FROM b WHERE NOT planned UNION ALL SELECT 'overlap', count(*), min(key) FROM b WHERE c > 1
    UNION ALL SELECT 'wrong_shard', count(*), min(key) FROM b WHERE planned AND c IS NOT NULL AND (s0 <> shard OR s1 <> shard) UNION ALL SELECT 'wrong_series', 0, NULL
    UNION ALL SELECT 'wrong_position', count(*), min(key) FROM b WHERE planned AND c IS NOT NULL AND (p0 <> position OR p1 <> position) UNION ALL SELECT 'other_identity', count(*), min(key) FROM b WHERE other > 0""")
def j09(t):
    return B.merge_rules(R.bank(t), R.partials(t), R.IDENTITY)


@query("j09b_merge_partials", "SELECT shard, count(*) AS n FROM fx_bank_plan GROUP BY shard")
def j09b(t):
    parts = R.bank(t)
    return B.merge_partials(parts, parts, R.IDENTITY).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


def finished(t):
    s = F.col("study_id").cast("bigint")
    return R.bank(t).select("study_id").distinct().filter(s % 3 != 1).withColumn("identity", F.when(s % 12 == 0, "bank-v0").otherwise(R.IDENTITY))


@query("j10_pending_ids", "SELECT DISTINCT study_id FROM fx_bank WHERE CAST(study_id AS BIGINT) % 3 = 1 OR CAST(study_id AS BIGINT) % 12 = 0")
def j10(t):
    return B.pending_ids(R.bank(t), finished(t), R.IDENTITY)


@query("j10b_expect_same_identity", rules_sql("(SELECT DISTINCT study_id FROM fx_bank)", "study_id", {"other_identity": "CAST(study_id AS BIGINT) % 12 = 0"}))
def j10b(t):
    return B.expect_same_identity(finished(t), R.IDENTITY)


# ---- ridge ----------------------------------------------------------------------

def design(t):
    pooled = B.slot_mean_pool(R.bank(t))
    return M.slot_design(pooled, B.slot_stats(pooled, fit_ids(t), R.WIDTH), R.WIDTH)


DESIGN_SQL = f"""SELECT p.study_id, p.slot * 64 + p.dim AS i, (p.x - coalesce(s.mean, 0)) / coalesce(s.std, 0.001::DOUBLE) AS x FROM fx_pooled p LEFT JOIN ({STATS_SQL}) s ON s.slot = p.slot AND s.dim = p.dim
    UNION ALL SELECT DISTINCT study_id, 384 + slot, 1.0::DOUBLE FROM fx_pooled"""


@query("m01_slot_design", f"""SELECT s.study_id, g.i, {r6('coalesce(d.x, 0)')} AS x FROM (SELECT DISTINCT study_id FROM fx_bank) s CROSS JOIN (SELECT unnest(range(390)) AS i) g
    LEFT JOIN ({DESIGN_SQL}) d ON d.study_id = s.study_id AND d.i = g.i""")
def m01(t):
    return design(t).select("study_id", F.posexplode("x").alias("i", "x"))


def soft_targets(t):
    """Three soft targets per study from the mean class label of its vectors."""
    mean = R.bank(t).groupBy("study_id").agg(F.avg("target").alias("m"))
    p = lambda d: F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.col("m") / F.lit(float(d))))
    return mean.select("study_id", F.explode(F.array(*[F.struct(F.lit(n).alias("label"), p(d).alias("p")) for n, d in (("x", 10), ("y", 12), ("z", 15))])).alias("r")).select("study_id", "r.*")


@query("m02_ridge_fit")
def m02(t):
    model = M.ridge_fit(design(t), M.target_logits(soft_targets(t), ["x", "y", "z"]), ["x", "y", "z"], 6 * R.WIDTH + 6)
    rows = [(label, float(b), float((c ** 2).sum() ** 0.5)) for label, c, b in zip(model.labels, model.coef, model.intercept)]
    return t.spark.createDataFrame(rows, "label string, intercept double, coef_norm double")


@query("m02b_ridge_optimality", """SELECT label, count(*) AS n, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS gradient
    FROM (SELECT DISTINCT study_id FROM fx_bank) CROSS JOIN (VALUES ('x'), ('y'), ('z')) AS l(label) GROUP BY label""")
def m02b(t):
    """At the optimum of the ridge loss the residuals of every label sum to zero and its
    gradient, X'r - alpha w relative to X'y, vanishes; both are taken in SQL from the fitted numbers."""
    alpha, labels = 1000.0, ["x", "y", "z"]
    x, y = design(t), M.target_logits(soft_targets(t), labels)
    model = M.ridge_fit(x, y, labels, 6 * R.WIDTH + 6, alpha)
    logits = model.predict(x).select("study_id", "label", "logit")
    wanted = y.select("study_id", F.explode(F.map_from_arrays(F.array(*[F.lit(v) for v in labels]), F.col("y"))).alias("label", "target"))
    rest = logits.join(wanted, ["study_id", "label"]).join(x, "study_id")
    terms = rest.select("label", (F.col("target") - F.col("logit")).alias("r"), "target", F.posexplode("x").alias("i", "x"))
    coef = t.spark.createDataFrame([(label, i, float(w)) for label, row in zip(labels, model.coef) for i, w in enumerate(row)], "label string, i int, w double")
    per = terms.groupBy("label", "i").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("residual"), F.sum(F.col("r") * F.col("x")).alias("xr"), F.sum(F.abs(F.col("target") * F.col("x"))).alias("scale")).join(coef, ["label", "i"])
    off = F.abs(F.col("xr") - F.lit(alpha) * F.col("w")) / (F.col("scale") + F.lit(1.0))
    return per.groupBy("label").agg(F.max("n").alias("n"), F.round(F.max(F.abs("residual")), 5).alias("residual"), F.round(F.max(off), 6).alias("gradient"))


@query("m03_ridge_predict", f"""WITH lin AS (SELECT d.study_id, l.label, sum(d.x * cos(d.i * 0.1::DOUBLE + l.j) * 0.05::DOUBLE) + l.j - 1 AS z FROM ({DESIGN_SQL}) d, (VALUES ('x', 0), ('y', 1), ('z', 2)) AS l(label, j) GROUP BY d.study_id, l.label, l.j)
    SELECT study_id, label, {r6('z')} AS logit, {r6('1 / (1 + exp(-z))')} AS prob FROM lin""")
def m03(t):
    import numpy as np
    i = np.arange(6 * R.WIDTH + 6)
    coef = np.stack([np.cos(i * 0.1 + j) * 0.05 for j in range(3)])
    return M.RidgeModel(["x", "y", "z"], coef, np.arange(3) - 1.0).predict(design(t))


@query("m04_soft_logistic_fit")
def m04(t):
    features = B.meanmax_pool(R.bank(t)).select("study_id", "pooled")
    soft = soft_targets(t)
    models = M.soft_logistic_fit(features, soft, ["x", "y"], iterations=10, reg=0.01)
    return M.soft_logistic_predict(models, features)


def head_weights(width: int, dim: int = 16, hidden: int = 8, classes: int = 2, slots: int = 6) -> dict:
    """Fixed, formula-made weights in the shape of an attention head."""
    import numpy as np
    w = lambda *shape: np.sin(np.arange(int(np.prod(shape))).reshape(shape) * 0.7) * 0.3
    return {"norm_w": np.ones(width), "norm_b": np.zeros(width), "proj_w": w(dim, width), "proj_b": w(dim), "slot": w(slots, dim), "pos1_w": w(dim, 1), "pos1_b": w(dim),
            "pos2_w": w(dim, dim), "pos2_b": w(dim), "att1_w": w(hidden, dim), "att1_b": w(hidden), "att2_w": w(classes, hidden), "att2_b": w(classes), "class_w": w(classes, dim), "class_b": w(classes)}


@query("m05_attention_score")
def m05(t):
    return M.attention_score(R.bank(t), head_weights(R.WIDTH), ["c0", "c1"])


def halves_model():
    """Stand-in encoder: mean of each half of the input."""
    import numpy as np
    return lambda x: np.stack([x[:, :x.shape[1] // 2].mean(1), x[:, x.shape[1] // 2:].mean(1)], axis=1)


@query("m06_batch_embed", f"""SELECT study_id, slot, k, round(avg(x) FILTER (dim < 32), 4) + 0.0 AS lo, round(avg(x) FILTER (dim >= 32), 4) + 0.0 AS hi FROM fx_dims GROUP BY ALL""")
def m06(t):
    rows = R.bank(t).select("study_id", "slot", "k", F.col("embedding").alias("pixels"))
    out = M.batch_embed(rows, halves_model, [R.WIDTH], 2)
    four = lambda i: F.round(F.col("embedding")[i].cast("double"), 4) + F.lit(0.0)
    return out.select("study_id", "slot", "k", four(0).alias("lo"), four(1).alias("hi"))

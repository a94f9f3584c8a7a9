"""Evaluation of predictions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluate as E
from ..operators import labels as L
from ..operators import models as M
from ..session import spread
from . import roles as R
from .label_queries import auc_sql
from .registry import query
from .role_sql import bits60, r6

PRED_ROWS = "SELECT model, label, study_id, score, y, 1 AS w FROM fx_predictions"
BOTH = "(SELECT a.study_id, a.label, a.y, a.score AS a, b.score AS b FROM fx_predictions a JOIN fx_predictions b ON b.study_id = a.study_id AND b.label = a.label AND a.model = 'a' AND b.model = 'b')"


@query("f01_sigmoid", f"SELECT event_id, {r6('CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END')} AS p FROM (SELECT event_id, value * 20 - 100 AS x FROM events)")
def f01(t):
    return t.events.select("event_id", S.sigmoid(F.col("value") * 20 - 100).alias("p"))


@query("f02_logit", f"SELECT study_id, label, {r6('ln(q) - ln(1 - q)')} AS logit FROM (SELECT study_id, label, CASE WHEN p IS NOT NULL THEN least(0.9999::DOUBLE, greatest(0.0001::DOUBLE, (p - 0.5) * 1.2 + 0.5)) END AS q FROM fx_soft)")
def f02(t):
    p = (F.col("p") - 0.5) * 1.2 + 0.5
    return R.soft(t).select("study_id", "label", S.logit(p).alias("logit"))


@query("a04_support", "SELECT label, count(*) FILTER (y = 1) AS positive, count(*) FILTER (y = 0) AS negative, count(*) AS n FROM fx_truth GROUP BY label")
def a04(t):
    return E.support(R.truth(t))


@query("a05_auc", f"SELECT model, label, n_pos, n_neg, {r6('auc')} AS auc FROM ({auc_sql(PRED_ROWS, 'model, label')})")
def a05(t):
    return E.auc(R.predictions(t), ["model", "label"])


HALF = "SELECT model, CASE WHEN CAST(study_id AS BIGINT) % 40 = 0 THEN label ELSE 'big-' || label END AS label, study_id, score, CASE WHEN label = 'toxic' AND CAST(study_id AS BIGINT) % 40 = 0 THEN 1 ELSE y END AS y, 1 AS w FROM fx_predictions"


def mixed(t):
    small = F.col("study_id").cast("bigint") % 40 == 0
    p = R.predictions(t).withColumn("y", F.when(small & (F.col("label") == "toxic"), 1).otherwise(F.col("y")))
    return p.withColumn("label", F.when(small, F.col("label")).otherwise(F.concat(F.lit("big-"), "label")))


@query("a06_macro_auc", f"""WITH a AS ({auc_sql(HALF, 'model, label')})
    SELECT model, 'skip_undefined' AS policy, {r6('avg(auc)')} AS macro_auc, count(auc) AS n_defined FROM a GROUP BY model
    UNION ALL SELECT model, 'require_all', {r6('CASE WHEN count(auc) = count(*) THEN avg(auc) END')}, count(auc) FROM a GROUP BY model""")
def a06(t):
    per = E.auc(mixed(t), ["model", "label"])
    tag = lambda p: E.macro_auc(per, ["model"], p).withColumn("policy", F.lit(p))
    return tag("skip_undefined").unionByName(tag("require_all"))


REPEATS, SEED = 20, 20261007
BOOT_ROWS = f"""SELECT d.rep, p.model, p.label, p.score, p.y, d.w FROM (
    SELECT rep, id AS study_id, count(*) AS w FROM (SELECT r AS rep, {bits60(f"'{SEED}:' || CAST(r AS VARCHAR) || ':' || CAST(j AS VARCHAR)")} % n + 1 AS o
      FROM (SELECT count(*) AS n FROM (SELECT DISTINCT study_id FROM fx_truth)), (SELECT unnest(range({REPEATS})) AS r), (SELECT row_number() OVER () - 1 AS j FROM (SELECT DISTINCT study_id FROM fx_truth))) dr
    JOIN (SELECT study_id AS id, row_number() OVER (ORDER BY study_id) AS o FROM (SELECT DISTINCT study_id FROM fx_truth)) ids ON ids.o = dr.o GROUP BY rep, id) d
    JOIN fx_predictions p ON p.study_id = d.study_id"""
BOOT = auc_sql(BOOT_ROWS, "rep, model, label")
MACRO = f"SELECT rep, model, label, auc FROM bt UNION ALL SELECT rep, model, 'MACRO', CASE WHEN count(auc) = count(*) THEN avg(auc) END FROM bt GROUP BY rep, model"


def boot(t):
    return E.bootstrap_auc(R.predictions(t), REPEATS, SEED)


@query("a07_bootstrap_auc", f"SELECT rep, model, label, {r6('auc')} AS auc FROM ({BOOT})")
def a07(t):
    return boot(t)


def poisson_cuts(n: int = 20) -> list[float]:
    out, total, term = [], 0.0, 2.718281828459045 ** -1
    for i in range(1, n + 1):
        total += term
        out.append(total)
        term /= i
    return out


POISSON_ROWS = f"""SELECT rep, model, label, score, y, w FROM (SELECT rep, model, label, score, y, {" + ".join(f"CASE WHEN u >= {c!r}::DOUBLE THEN 1 ELSE 0 END" for c in poisson_cuts())} AS w
    FROM (SELECT rep, p.*, CAST(('0x' || substr(md5('{SEED}:' || CAST(rep AS VARCHAR) || ':' || study_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
      FROM fx_predictions p, (SELECT unnest(range(10)) AS rep) r)) WHERE w > 0"""


@query("a07b_bootstrap_poisson", f"SELECT rep, model, label, {r6('auc')} AS auc FROM ({auc_sql(POISSON_ROWS, 'rep, model, label')})")
def a07b(t):
    return E.bootstrap_auc(R.predictions(t), 10, SEED, method="poisson")


def ci_sql(value: str, source: str) -> str:
    return f"""SELECT model, label, {r6(f'quantile_cont({value}, 0.025::DOUBLE)')} AS low, {r6(f'quantile_cont({value}, 0.975::DOUBLE)')} AS high, count({value}) AS defined, count(*) - count({value}) AS dropped
      FROM {source} GROUP BY model, label"""


@query("a08_percentile_ci", f"WITH bt AS ({BOOT}), m AS ({MACRO}) {ci_sql('auc', 'm')}")
def a08(t):
    return E.percentile_ci(E.with_macro(boot(t)), ["model", "label"], "auc")


@query("a09_paired_delta", f"WITH bt AS ({BOOT}), m AS ({MACRO}), d AS (SELECT m.model, m.label, m.auc - r.auc AS delta FROM m JOIN m r ON r.rep = m.rep AND r.label = m.label AND r.model = 'a') {ci_sql('delta', 'd')}")
def a09(t):
    return E.percentile_ci(E.paired_delta(boot(t), "a"), ["model", "label"], "delta")


def rank_sql(by: str, value: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0::DOUBLE"


@query("a09b_diagnostics", f"""WITH bt AS ({BOOT}), m AS ({MACRO}), d AS (SELECT m.model, m.label, m.auc - r.auc AS delta FROM m JOIN m r ON r.rep = m.rep AND r.label = m.label AND r.model = 'a'),
    ci AS ({ci_sql('auc', 'm')}), di AS ({ci_sql('delta', 'd')}), pt AS (SELECT model, label, auc FROM ({auc_sql(PRED_ROWS, 'model, label')})),
    pm AS (SELECT * FROM pt UNION ALL SELECT model, 'MACRO', CASE WHEN count(auc) = count(*) THEN avg(auc) END FROM pt GROUP BY model),
    met AS (SELECT p.model, p.label, p.y, p.score AS a, r.score AS b FROM fx_predictions p JOIN fx_predictions r ON r.study_id = p.study_id AND r.label = p.label AND r.model = 'a'),
    rk AS (SELECT model, label, {rank_sql('model, label', 'a')} AS ra, {rank_sql('model, label', 'b')} AS rb, (a >= 0.5) <> (y = 1) AS ea, (b >= 0.5) <> (y = 1) AS eb FROM met),
    ag AS (SELECT model, label, {r6('greatest(-1.0, least(1.0, corr(ra, rb)))')} AS spearman, {r6('count(*) FILTER (ea AND eb) / nullif(count(*) FILTER (ea OR eb), 0)::DOUBLE')} AS error_jaccard FROM rk GROUP BY ALL)
    SELECT pm.model, pm.label, {r6('pm.auc')} AS auc, ci.low, ci.high, {r6('pm.auc - ref.auc')} AS delta, di.low AS delta_low, di.high AS delta_high, ci.defined, ci.dropped, spearman, error_jaccard
    FROM pm JOIN pm ref ON ref.label = pm.label AND ref.model = 'a' LEFT JOIN ci ON ci.model = pm.model AND ci.label = pm.label LEFT JOIN di ON di.model = pm.model AND di.label = pm.label
      LEFT JOIN ag ON ag.model = pm.model AND ag.label = pm.label""")
def a09b(t):
    return E.diagnostics(R.predictions(t), "a", REPEATS, SEED)


@query("a10_spearman", f"""SELECT label, count(*) AS n, {r6('greatest(-1.0, least(1.0, corr(ra, rb)))')} AS spearman FROM (SELECT label, {rank_sql('label', 'a')} AS ra, {rank_sql('label', 'b')} AS rb FROM {BOTH}) GROUP BY label
    UNION ALL SELECT 'constant', count(*), NULL FROM {BOTH} WHERE label = 'toxic'""")
def a10(t):
    both = R.both_models(t)
    flat = both.filter("label = 'toxic'").withColumn("label", F.lit("constant")).withColumn("b", F.lit(0.25))
    return E.spearman(both.unionByName(flat), ["label"], "a", "b")


@query("a11_error_overlap", f"""WITH e AS (SELECT study_id, label, (a >= 0.5) <> (y = 1) AS ea, (b >= 0.5) <> (y = 1) AS eb FROM {BOTH}),
    s AS (SELECT study_id, bool_or(ea) AS ea, bool_or(eb) AS eb FROM e GROUP BY study_id), u AS (SELECT 'label:' || label AS scope, ea, eb FROM e UNION ALL SELECT 'all', ea, eb FROM e UNION ALL SELECT 'any_error', ea, eb FROM s)
    SELECT scope, count(*) FILTER (ea AND eb) AS both_wrong, count(*) FILTER (ea AND NOT eb) AS a_only_wrong, count(*) FILTER (NOT ea AND eb) AS b_only_wrong, count(*) FILTER (NOT ea AND NOT eb) AS both_correct,
           {r6('count(*) FILTER (ea AND eb) / nullif(count(*) FILTER (ea OR eb), 0)::DOUBLE')} AS jaccard FROM u GROUP BY scope""")
def a11(t):
    return E.error_overlap(R.both_models(t), "a", "b")


@query("a12_prediction_spread", f"SELECT model, label, {r6('min(score)')} AS min, {r6('max(score)')} AS max, {r6('stddev_pop(score)')} AS std FROM fx_predictions GROUP BY ALL")
def a12(t):
    return E.prediction_spread(R.predictions(t), ["model", "label"])


@query("a13_soft_bce", f"""WITH r AS (SELECT s.label, s.p, x FROM fx_soft s JOIN (SELECT CAST(doc_id AS VARCHAR) AS study_id, n_chars / 2000.0::DOUBLE - 1 AS x FROM documents) d USING (study_id) WHERE p IS NOT NULL)
    SELECT label, count(*) AS n, {r6('avg(greatest(x, 0) - x * p + ln(1 + exp(-abs(x))))')} AS bce, {r6('avg(-p * ln(p) - (1 - p) * ln(1 - p))')} AS target_entropy, {r6('-avg(p) * ln(avg(p)) - (1 - avg(p)) * ln(1 - avg(p))')} AS prevalence_bce FROM r GROUP BY label""")
def a13(t):
    x = t.documents.select(R.text("doc_id").alias("study_id"), (F.col("n_chars") / 2000 - 1).alias("logit"))
    return E.soft_bce(R.soft(t).filter("p IS NOT NULL").join(x, "study_id"), ["label"])


@query("w11_average_rank", f"SELECT model, label, study_id, {r6(rank_sql('model, label', 'score'))} AS rank FROM fx_predictions")
def w11(t):
    from ..operators.ordering import with_average_rank
    return with_average_rank(R.predictions(t), ["model", "label"], "score").select("model", "label", "study_id", "rank")


PR = f"SELECT model, label, study_id, ({rank_sql('model, label', 'score')}) / count(*) OVER (PARTITION BY model, label) AS pr FROM fx_predictions"


@query("w10_percentile_rank", f"SELECT model, label, study_id, {r6('pr')} AS pr FROM ({PR})")
def w10(t):
    return E.percentile_rank(R.predictions(t), ["model", "label"], "score").select("model", "label", "study_id", "pr")


@query("w12_rank_blend", f"""WITH m AS (SELECT study_id, label, round(sum(CASE model WHEN 'a' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END * pr), 12) AS mix FROM ({PR}) GROUP BY ALL)
    SELECT study_id, label, {r6(f"({rank_sql('label', 'mix')}) / count(*) OVER (PARTITION BY label)")} AS blend FROM m""")
def w12(t):
    return E.rank_blend(R.predictions(t), {"a": 0.7, "b": 0.3})


@query("m07_ensemble_mean", f"SELECT study_id, label, {r6('avg(score)')} AS prob FROM fx_predictions GROUP BY ALL")
def m07(t):
    return E.ensemble_mean(R.predictions(t).withColumnRenamed("score", "prob"))


@query("m08_fixed_blend", f"SELECT study_id, label, {r6('0.5::DOUBLE * a + 0.5::DOUBLE * b')} AS prob FROM {BOTH}")
def m08(t):
    p = R.predictions(t).withColumnRenamed("score", "prob")
    return E.fixed_blend(p.filter("model = 'a'"), p.filter("model = 'b'"))


@query("j08_align_predictions", f"SELECT model, study_id, label, {r6('score')} AS score, {r6('y')} AS y FROM fx_predictions")
def j08(t):
    wide = lambda m: L.pivot_labels(R.predictions(t).filter(F.col("model") == m), ["study_id"], R.LABELS, "score")
    return E.align_predictions(R.official(t).filter("quality IS NOT NULL"), {"a": wide("a"), "b": wide("b")}, R.LABELS)


MATRIX = auc_sql("""SELECT t.label AS target, p.label AS "column", p.score, t.y, 1 AS w FROM fx_truth t JOIN fx_predictions p ON p.study_id = t.study_id AND p.model = 'a'""", 'target, "column"')


def matrix(t):
    targets = R.truth(t).withColumnRenamed("label", "target")
    preds = R.predictions(t).filter("model = 'a'").select("study_id", F.col("label").alias("column"), "score")
    return E.auc_matrix(targets, preds)


@query("j11_auc_matrix", f'SELECT target, "column", {r6("auc")} AS auc FROM ({MATRIX})')
def j11(t):
    return matrix(t)


@query("o05_best_column", f"""SELECT target, "column", {r6('auc')} AS auc FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY auc DESC, "column") AS r FROM ({MATRIX}) WHERE auc IS NOT NULL) WHERE r = 1""")
def o05(t):
    return E.best_column(matrix(t))


@query("a41_delta_table", f"""WITH a AS ({auc_sql(PRED_ROWS, 'model, label')}), l AS (SELECT label, auc FROM a WHERE model = 'a' UNION ALL SELECT 'MACRO', avg(auc) FROM a WHERE model = 'a'),
    r AS (SELECT label, auc FROM a WHERE model = 'b' AND label <> 'toxic' UNION ALL SELECT 'MACRO', avg(auc) FROM a WHERE model = 'b')
    SELECT coalesce(l.label, r.label) AS label, {r6('l.auc')} AS a, {r6('r.auc')} AS b, {r6('r.auc - l.auc')} AS delta FROM l FULL JOIN r ON r.label = l.label""")
def a41(t):
    per = E.auc(R.predictions(t), ["model", "label"])
    macro = E.macro_auc(per, ["model"]).select("model", F.lit("MACRO").alias("label"), F.col("macro_auc").alias("auc"))
    rows = per.select("model", "label", "auc")
    pick = lambda m, r: r.filter(F.col("model") == m).select("label", "auc")
    left = pick("a", rows).unionByName(pick("a", macro))
    right = pick("b", rows).filter("label <> 'toxic'").unionByName(pick("b", macro))
    return E.delta_table(left, right, ["label"], "auc")


@query("m09_train_eval_report")
def m09(t):
    """Ridge on letter counts of the whole texts, holdout and gold phases."""
    width = 16
    letters = "etaoinsrhldcumpg"
    counts = F.array(*[F.sqrt((F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("double")) for c in letters])
    pooled = spread(t.documents.select("doc_id", "text"), "doc_id").select(R.text("doc_id").alias("study_id"), F.lit(0).alias("slot"), counts.alias("pooled"))
    return M.train_eval_report(None, R.soft(t), R.truth(t), R.report_roles(t), R.LABELS, width, slots=1, alpha=10.0, pooled=pooled)


@query("m10_replay_check", f"""WITH r AS (SELECT study_id, label, score AS s, CASE WHEN CAST(study_id AS BIGINT) % 60 = 0 THEN score + 0.01 ELSE score END AS n FROM fx_predictions WHERE model = 'a')
    SELECT count(*) AS n_saved, count(*) FILTER (CAST(study_id AS BIGINT) % 75 <> 1) AS n_replayed, count(*) FILTER (CAST(study_id AS BIGINT) % 75 = 1) AS uncovered, 0::BIGINT AS duplicates,
           {r6('max(abs(n - s)) FILTER (CAST(study_id AS BIGINT) % 75 <> 1)')} AS max_abs_difference, count(*) FILTER (CAST(study_id AS BIGINT) % 75 <> 1 AND n <> s) AS outside, FALSE AS matches FROM r""")
def m10(t):
    saved = R.predictions(t).filter("model = 'a'").withColumnRenamed("score", "prob")
    s = F.col("study_id").cast("bigint")
    again = saved.filter(s % 75 != 1).withColumn("prob", F.when(s % 60 == 0, F.col("prob") + 0.01).otherwise(F.col("prob")))
    return M.replay_check(saved, again)


@query("m10b_metric_check", f"SELECT model, label, label <> 'toxic' AS same FROM ({auc_sql(PRED_ROWS, 'model, label')})")
def m10b(t):
    per = E.auc(R.predictions(t), ["model", "label"])
    moved = per.withColumn("auc", F.when(F.col("label") == "toxic", F.col("auc") + 1e-9).otherwise(F.col("auc")))
    return M.metric_check(per, moved, ["model", "label"]).select("model", "label", "same")


@query("m11_controlled_comparison", f"""WITH a AS ({auc_sql(PRED_ROWS, 'model, label')})
    SELECT 'a' AS left_run, 'b' AS right_run, 'gold' AS population, l.label, {r6('l.auc')} AS auc_left, {r6('r.auc')} AS auc_right, {r6('r.auc - l.auc')} AS delta FROM a l JOIN a r ON r.label = l.label AND l.model = 'a' AND r.model = 'b'""")
def m11(t):
    preds = R.predictions(t)
    from ..operators.audit import ids_digest
    digest = ids_digest(R.truth(t).select("study_id").distinct(), "study_id").select(F.col("digest").alias("ids_digest"), F.lit("bank").alias("bank_digest"))
    config = lambda head, name: F.create_map(F.lit("head"), F.lit(head), F.lit("experiment"), F.lit(name), F.lit("seed"), F.lit("42"))
    run = lambda m, c: digest.select(F.lit(m).alias("run_id"), c.alias("config"), "bank_digest", "ids_digest")
    runs = run("a", config("attention", "one")).unionByName(run("b", config("meanmax", "two"))).unionByName(
        digest.select(F.lit("c").alias("run_id"), config("meanmax", "two").alias("config"), F.lit("other bank").alias("bank_digest"), "ids_digest"))
    pairs = digest.select(F.explode(F.array(F.struct(F.lit("a").alias("left_run"), F.lit("b").alias("right_run")), F.struct(F.lit("a").alias("left_run"), F.lit("c").alias("right_run")))).alias("p")).select("p.*")
    metrics = E.auc(preds, ["model", "label"]).select(F.col("model").alias("run_id"), F.lit("gold").alias("population"), "label", "auc")
    return M.controlled_comparison(runs, pairs, ["head", "experiment"], metrics)

"""Evaluation of long prediction tables (model, study_id, label, score, y)."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import pin, stored
from .ordering import no_nan, range_cuts, running_totals, value_range, with_average_rank, with_row_number


def support(df: DataFrame, by: list[str] = ("label",), y: str = "y") -> DataFrame:
    pos = F.count_if(F.col(y) == 1)
    return df.groupBy(*by).agg(pos.alias("positive"), F.count_if(F.col(y) == 0).alias("negative"), F.count(y).alias("n"))


def auc(df: DataFrame, by: list[str], score: str = "score", y: str = "y", weight: str | None = None) -> DataFrame:
    """Tie-aware ROC AUC per group, exact; NULL where a class is missing.

    Rows are first collapsed per distinct score, so the ordered part never sees
    repeated scores and never holds a whole group in one task.
    """
    w = F.col(weight).cast("double") if weight else S.dbl(1)
    data = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull())
    t = running_totals(data, by, score, {"pos": F.when(F.col(y) == 1, w).otherwise(S.dbl(0)),
                                         "neg": F.when(F.col(y) == 0, w).otherwise(S.dbl(0))})
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / S.dbl(2)))
    out = t.groupBy(*by).agg(wins.alias("_wins"), F.max("pos_all").alias("_p"), F.max("neg_all").alias("_n"))
    return out.select(*by, F.col("_p").cast("bigint").alias("n_pos"), F.col("_n").cast("bigint").alias("n_neg"),
                      F.try_divide(F.col("_wins"), F.col("_p") * F.col("_n")).alias("auc"))


def macro_auc(per_label: DataFrame, by: list[str], policy: str = "skip_undefined") -> DataFrame:
    """Mean over labels; `require_all` gives NULL as soon as one is undefined."""
    out = per_label.groupBy(*by).agg(F.avg("auc").alias("macro_auc"), F.count("auc").alias("n_defined"), F.count(F.lit(1)).alias("_all"))
    if policy == "require_all":
        out = out.withColumn("macro_auc", F.when(F.col("n_defined") == F.col("_all"), F.col("macro_auc")))
    elif policy != "skip_undefined":
        raise ValueError(policy)
    return out.drop("_all")


# ---- bootstrap --------------------------------------------------------------

def bootstrap_draws(ids: DataFrame, key: str, repeats: int, seed: int) -> DataFrame:
    """(rep, key, w): study counts of `repeats` resamples with replacement.

    Draw j of repeat rep is a hash of (seed, rep, j) modulo n, the same for every
    model and label.
    """
    distinct = pin(ids.select(key).distinct())  # one column, read three times
    numbered = with_row_number(distinct, [], [F.col(key).asc()], "_ord")
    n = distinct.count()
    draws = ids.sparkSession.range(repeats * n).select(F.floor(F.col("id") / n).alias("rep"), (F.col("id") % n).alias("j"))
    drawn = draws.select("rep", (S.hash_index(n, F.lit(seed), "rep", "j") + 1).alias("_ord"))
    counts = drawn.groupBy("rep", "_ord").agg(F.count(F.lit(1)).alias("w"))
    return counts.join(numbered, "_ord").select("rep", key, "w")


def poisson_draws(ids: DataFrame, key: str, repeats: int, seed: int) -> DataFrame:
    """Poisson(1) weights per (rep, key): another estimator, only on request. Needs
    no ordinal and no draw table, so it suits very many rows."""
    reps = ids.select(key).distinct().withColumn("rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(repeats - 1).cast("bigint"))))
    u = S.hash_uniform(F.lit(seed), F.col("rep"), F.col(key))
    steps, total, term = [], 0.0, 2.718281828459045 ** -1
    for i in range(1, 21):
        total += term
        steps.append((u >= S.dbl(total)).cast("bigint"))
        term /= i
    return reps.select("rep", key, reduce(lambda a, b: a + b, steps).alias("w")).filter("w > 0")


def bootstrap_weights(draws: DataFrame, key: str) -> DataFrame:
    """(key, d): one row per study, with its (rep, w) pairs of all repeats."""
    return draws.groupBy(key).agg(F.collect_list(F.struct(F.col("rep").cast("int").alias("rep"), F.col("w").cast("int").alias("w"))).alias("d"))


def _range_wins(repeats: int):
    """Per repeat, sums of one range of scores: weights of both classes, and pairs won inside the range."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("score")
        score, y, d = t["score"].to_numpy(), t["y"].to_numpy(), t["d"].combine_chunks()
        pairs = d.flatten()
        w = np.zeros((len(t), repeats), np.int32)
        w[np.repeat(np.arange(len(t)), pc.list_value_length(d).to_numpy(zero_copy_only=False)), pairs.field("rep").to_numpy()] = pairs.field("w").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
        pos, neg = (np.add.reduceat(w * (y == c)[:, None], first, 0).astype(np.float64) for c in (1, 0))
        wins = (pos * (np.cumsum(neg, 0) - neg / 2)).sum(0)
        sums = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (pos.sum(0), neg.sum(0), wins)]
        return pa.table([*(t[c].slice(0, 1) for c in ("model", "label", "_b")), *sums], ["model", "label", "_b", "pos", "neg", "wins"])

    return run


def bootstrap_auc(df: DataFrame, repeats: int, seed: int, method: str = "resample", cells: int = 4_000_000) -> DataFrame:
    """(rep, model, label, auc): paired study bootstrap; undefined repeats are NULL.

    A study's weights in all repeats travel with its predictions, and scores are ordered
    once for all repeats: each range of scores gives its class weights and the pairs won
    inside it, and pairs across ranges follow from the weights of the ranges below. A
    range holds `cells` weights; a score that fills several ranges is a range of its own,
    dealt by study, as its sums need no order.
    """
    ids = df.select("study_id")
    draws = (bootstrap_draws if method == "resample" else poisson_draws)(ids, "study_id", repeats, seed)
    known = stored(no_nan(df.filter(F.col("score").isNotNull() & F.col("y").isNotNull()), "score").select("study_id", "model", "label", F.col("score").cast("double").alias("score"), "y"), "scored")
    cuts = range_cuts(known, "score", max(1000, cells // repeats))
    full = sorted({c for c in cuts if cuts.count(c) > 1})
    hot = F.array_contains(F.array(*[F.lit(c) for c in full]), F.col("score")) if full else F.lit(False)
    dealt = known.join(bootstrap_weights(draws, "study_id"), "study_id").withColumns({
        "_b": 2 * value_range("score", sorted(set(cuts))) + F.when(hot, 0).otherwise(1),
        "_s": F.when(hot, F.pmod(F.xxhash64("study_id"), F.lit(len(cuts) + 1))).otherwise(F.lit(0))})
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    parts = dealt.groupBy("model", "label", "_b", "_s").applyInArrow(
        _range_wins(repeats), f"model {kinds['model']}, label {kinds['label']}, _b int, pos array<double>, neg array<double>, wins array<double>")
    reps = parts.select("model", "label", "_b", F.posexplode(F.arrays_zip("pos", "neg", "wins")).alias("rep", "z"))
    ranges = reps.groupBy("model", "label", "rep", "_b").agg(*[F.sum(f"z.{c}").alias(c) for c in ("pos", "neg", "wins")])
    inside = F.when(F.col("_b") % 2 == 0, F.col("pos") * F.col("neg") / 2).otherwise(F.col("wins"))
    below = Window.partitionBy("model", "label", "rep").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    won = ranges.withColumn("_won", inside + F.col("pos") * F.coalesce(F.sum("neg").over(below), S.dbl(0)))
    out = won.groupBy("model", "label", "rep").agg(F.sum("_won").alias("_won"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n")).filter("_p + _n > 0")
    return out.select(F.col("rep").cast("bigint").alias("rep"), "model", "label", F.try_divide(F.col("_won"), F.col("_p") * F.col("_n")).alias("auc"))


def percentile_ci(df: DataFrame, by: list[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval over defined repeats, with defined and dropped counts.
    A group holds one value per repeat, so percentile() is bounded by the repeats."""
    x = S.null_if_nan(value)
    out = df.groupBy(*by).agg(F.percentile(x, F.array(S.dbl(low), S.dbl(high))).alias("_q"),
                              F.count(x).alias("defined"), F.count_if(x.isNull()).alias("dropped"))
    return out.select(*by, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), "defined", "dropped")


def with_macro(boot: DataFrame, value: str = "auc") -> DataFrame:
    """Adds label 'MACRO' rows: the mean where every label is defined, else NULL."""
    # a (rep, model) group holds one row per label, so its list is short
    lists = boot.groupBy("rep", "model").agg(F.collect_list(F.struct("label", value)).alias("_r"), F.avg(value).alias("_m"),
                                             (F.count(value) == F.count(F.lit(1))).alias("_all"))
    macro = F.array(F.struct(F.lit("MACRO").alias("label"), F.when(F.col("_all"), F.col("_m")).alias(value)))
    return lists.select("rep", "model", F.explode(F.concat("_r", macro)).alias("_r")).select("rep", "model", "_r.*")


def paired_delta(boot: DataFrame, reference: str) -> DataFrame:
    """Per repeat difference to the reference model, per label and MACRO."""
    # a (rep, label) group holds one row per model, so no self-join is needed
    lists = with_macro(boot).groupBy("rep", "label").agg(F.collect_list(F.struct("model", "auc")).alias("_r"),
                                                         F.max(F.when(F.col("model") == reference, F.col("auc"))).alias("_ref"))
    return lists.select("rep", "label", "_ref", F.explode("_r").alias("_r")).select(
        "rep", "_r.model", "label", (F.col("_r.auc") - F.col("_ref")).alias("delta"))


# ---- agreement ----------------------------------------------------------------

def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Pearson correlation of average ranks in [-1, 1] over the complete pairs; NULL if one side is constant."""
    df = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    # both ranks come from the input itself, so neither waits for the other
    one = {"_c": F.lit(1).cast("bigint")}
    rank = lambda v, out: running_totals(df, by, v, one).select(*by, v, (F.col("_c_below") + (F.col("_c") + 1) / S.dbl(2)).alias(out))
    ranked = df.select(*by, a, b).join(rank(a, "_ra"), [*by, a]).join(rank(b, "_rb"), [*by, b])
    out = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("_ra", "_rb"), F.stddev_pop("_ra") * F.stddev_pop("_rb")).alias("_c"), F.min("_ra").alias("a0"),
                                  F.max("_ra").alias("a1"), F.min("_rb").alias("b0"), F.max("_rb").alias("b1"))
    varies = (F.col("a0") < F.col("a1")) & (F.col("b0") < F.col("b1"))
    return out.select(*by, "n", F.when(varies, F.greatest(S.dbl(-1), F.least(S.dbl(1), F.col("_c")))).alias("spearman"))


def _overlap(df: DataFrame, scope: Column) -> DataFrame:
    a, b = F.col("_a"), F.col("_b")
    n = lambda c: F.sum(F.when(c, F.col("_w")).otherwise(F.lit(0)))
    out = df.groupBy(scope.alias("scope")).agg(n(a & b).alias("both_wrong"), n(a & ~b).alias("a_only_wrong"),
                                              n(~a & b).alias("b_only_wrong"), n(~a & ~b).alias("both_correct"))
    union = F.col("both_wrong") + F.col("a_only_wrong") + F.col("b_only_wrong")
    return out.withColumn("jaccard", F.try_divide(F.col("both_wrong").cast("double"), union.cast("double")))


def error_overlap(df: DataFrame, a: str, b: str, threshold: float = 0.5) -> DataFrame:
    """Error overlap of two probability columns: per label, over all decisions, and
    over studies with any error. df(study_id, label, y, a, b)."""
    # a missing decision would vanish from all four cells
    known = lambda e, c: F.when(e.isNull(), F.raise_error(F.lit(f"missing value in {c}"))).otherwise(e)
    wrong = lambda c: known(S.binarize(c, threshold), c) != known(F.col("y"), "y")
    rows = df.select("study_id", "label", wrong(a).alias("_a"), wrong(b).alias("_b"), F.lit(1).cast("bigint").alias("_w"))
    cells = rows.groupBy("label", "_a", "_b").agg(F.sum("_w").alias("_w"))
    studies = rows.groupBy("study_id").agg(F.bool_or("_a").alias("_a"), F.bool_or("_b").alias("_b")).withColumn("_w", F.lit(1).cast("bigint"))
    return (_overlap(cells, F.concat(F.lit("label:"), F.col("label"))).unionByName(_overlap(cells, F.lit("all")))
            .unionByName(_overlap(studies, F.lit("any_error"))))


def prediction_spread(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    return df.groupBy(*by).agg(F.min(score).alias("min"), F.max(score).alias("max"), F.stddev_pop(score).alias("std"))


def soft_bce(df: DataFrame, by: list[str], logit: str = "logit", target: str = "p") -> DataFrame:
    """Soft-target cross entropy from logits, with its two yardsticks: the entropy of
    the targets and the loss of the constant prevalence."""
    x, t = F.col(logit).cast("double"), F.col(target).cast("double")
    loss = F.greatest(x, S.dbl(0)) - x * t + F.log1p(F.exp(-F.abs(x)))
    part = lambda p: F.when(p > 0, -p * F.log(p)).otherwise(S.dbl(0))
    entropy = lambda p: part(p) + part(S.dbl(1) - p)
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("bce"), F.avg(entropy(t)).alias("target_entropy"), F.avg(t).alias("_q"))
    return out.withColumn("prevalence_bce", entropy(F.col("_q"))).drop("_q")


# ---- ranks and blends -----------------------------------------------------------

def percentile_rank(df: DataFrame, by: list[str], value: str, out: str = "pr") -> DataFrame:
    ranked = with_average_rank(df, by, value, "_r")
    return ranked.withColumn(out, F.col("_r") / F.col("_r_n")).drop("_r", "_r_n")


def rank_blend(preds: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of per-label percentile ranks, ranked again. Every model must have
    one score for every (study_id, label) that any of them has."""
    ranked = percentile_rank(preds.filter(F.col("model").isin(*weights)), ["model", "label"], "score")
    w = reduce(lambda c, kv: c.when(F.col("model") == kv[0], S.dbl(kv[1])), weights.items(), F.when(F.lit(False), S.dbl(0)))
    voices = F.count(F.lit(1))
    full = F.when((voices == len(weights)) & (F.count_distinct("model") == len(weights)), F.sum(w * F.col("pr")))
    mixed = ranked.groupBy("study_id", "label").agg(full.otherwise(F.raise_error(F.lit("a model lacks or repeats a prediction"))).alias("mix"))
    # equal mixes must tie whatever the order of addition was
    return percentile_rank(mixed.withColumn("mix", F.round("mix", 12)), ["label"], "mix", "blend").select("study_id", "label", "blend")


def ensemble_mean(preds: DataFrame, keys: list[str] = ("study_id", "label"), prob: str = "prob", members: int | None = None) -> DataFrame:
    """Mean over members; with `members`, a key that has not that many values is an error."""
    mean = F.avg(prob)
    if members is not None:
        mean = F.when(F.count(prob) == members, mean).otherwise(F.raise_error(F.lit(f"a key has not {members} members")))
    return preds.groupBy(*keys).agg(mean.alias(prob))


def fixed_blend(a: DataFrame, b: DataFrame, weight: float = 0.5, prob: str = "prob") -> DataFrame:
    """weight * a + (1 - weight) * b on (study_id, label); declared, never searched."""
    side = lambda df, tag: df.select("study_id", "label", F.col(prob).alias(tag))
    both = side(a, "_a").join(side(b, "_b"), ["study_id", "label"], "full")
    mixed = S.dbl(weight) * F.col("_a") + S.dbl(1 - weight) * F.col("_b")
    return both.select("study_id", "label", F.coalesce(mixed, F.raise_error(F.lit("a side lacks a prediction"))).alias(prob))


def align_predictions(truth: DataFrame, models: dict[str, DataFrame], labels: list[str], key: str = "study_id") -> DataFrame:
    """Join wide predictions to wide truth by id: long (model, id, label, score, y).
    Check id sets first with coverage_report; file order never matters."""
    from .labels import unpivot
    gold = unpivot(truth, [key], labels, "label", "y")
    preds = reduce(DataFrame.unionByName, [unpivot(df, [key], labels, "label", "score").withColumn("model", F.lit(m)) for m, df in models.items()])
    return preds.join(gold, [key, "label"]).select("model", key, "label", "score", "y")


def auc_matrix(targets: DataFrame, preds: DataFrame) -> DataFrame:
    """AUC of each target label (study_id, target, y) against each prediction column
    (study_id, column, score). Rows meet by study id only."""
    both = targets.join(preds, "study_id")
    return auc(both, ["target", "column"]).select("target", "column", "auc")


def best_column(matrix: DataFrame) -> DataFrame:
    """Column of greatest AUC per target; ties go to the smaller name."""
    best = F.min(F.struct((-F.col("auc")).alias("_neg"), F.col("column"))).alias("_b")
    return matrix.filter("auc IS NOT NULL").groupBy("target").agg(best).select("target", F.col("_b.column").alias("column"), (-F.col("_b._neg")).alias("auc"))


def delta_table(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """b - a per key; NULL where either side is missing or undefined."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full")
    return both.withColumn("delta", F.col("b") - F.col("a"))


def diagnostics(preds: DataFrame, reference: str, repeats: int, seed: int, threshold: float = 0.5) -> DataFrame:
    """One row per model and label, and MACRO: point AUC with its interval, the paired
    difference to the reference model with its interval, defined and dropped repeats,
    and rank correlation and error overlap with the reference.

    preds(model, study_id, label, score, y). The reference has difference 0 and agrees with itself.
    """
    point = auc(preds, ["model", "label"])
    macro = macro_auc(point, ["model"], "require_all").select("model", F.lit("MACRO").alias("label"), F.col("macro_auc").alias("auc"))
    points = point.select("model", "label", "auc").unionByName(macro)
    boot = stored(bootstrap_auc(preds, repeats, seed), "boot")
    interval = percentile_ci(with_macro(boot), ["model", "label"], "auc")
    delta = percentile_ci(paired_delta(boot, reference), ["model", "label"], "delta").select(
        "model", "label", F.col("low").alias("delta_low"), F.col("high").alias("delta_high"))
    own = points.filter(F.col("model") == reference).select("label", F.col("auc").alias("_ref"))
    other = preds.filter(F.col("model") == reference).select("study_id", "label", F.col("score").alias("_b"))
    met = preds.select("model", "study_id", "label", "y", F.col("score").alias("_a")).join(other, ["study_id", "label"])
    ranks = spearman(met, ["model", "label"], "_a", "_b").select("model", "label", "spearman")
    wrong = lambda c: S.binarize(c, threshold) != F.col("y")
    both, either = F.count_if(wrong("_a") & wrong("_b")), F.count_if(wrong("_a") | wrong("_b"))
    overlap = met.groupBy("model", "label").agg(F.try_divide(both.cast("double"), either.cast("double")).alias("error_jaccard"))
    return (points.join(interval, ["model", "label"], "left").join(own, "label", "left").join(delta, ["model", "label"], "left")
            .join(ranks, ["model", "label"], "left").join(overlap, ["model", "label"], "left")
            .select("model", "label", "auc", "low", "high", (F.col("auc") - F.col("_ref")).alias("delta"), "delta_low", "delta_high", "defined", "dropped", "spearman", "error_jaccard"))

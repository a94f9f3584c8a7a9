"""Readout models on a bank: slot-centred ridge, soft logistic, attention scoring."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..session import pin
from .bank import attention_pool, slot_mean_pool, slot_stats
from .checks import expect_disjoint, require_clean, split_roles
from .evaluate import auc, macro_auc



# ---- design -------------------------------------------------------------------

def slot_design(pooled: DataFrame, stats: DataFrame, width: int, slots: int = 6) -> DataFrame:
    """(study_id, x): standardised slot vectors, zeros for absent slots, then one
    presence bit per slot. `stats` has one row per slot, so Spark broadcasts it."""
    z = F.transform(F.arrays_zip(F.col("pooled").alias("p"), F.col("mean").alias("m"), F.col("std").alias("s")),
                    lambda t: (t["p"].cast("double") - t["m"]) / t["s"])
    scaled = pooled.join(stats.select("slot", "mean", "std"), "slot").select("study_id", "slot", z.alias("z"))
    wide = scaled.groupBy("study_id").pivot("slot", list(range(slots))).agg(F.first("z"))
    zeros = F.array_repeat(S.dbl(0), width)
    bits = F.array(*[F.col(f"`{s}`").isNotNull().cast("double") for s in range(slots)])
    return wide.select("study_id", F.concat(*[F.coalesce(f"`{s}`", zeros) for s in range(slots)], bits).alias("x"))


# ---- ridge --------------------------------------------------------------------

def gram_matrices(df: DataFrame, cols: list[str], width: int, by: str | None = None, block: int = 512) -> dict[int, np.ndarray]:
    """Sum over rows of z z^T for z = [1, cols...] (arrays concatenated), per value of
    the small integer column `by` (key -1 without one).

    Input splits are read by one task per core at most; each adds up its rows in
    numpy and emits the upper triangle of its partial matrix, row by row, so what is
    shuffled does not grow with the number of splits. Those rows are summed on Spark.
    The driver holds the width x width results; `ridge_fit(method="cg")` needs none.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for at in range(0, len(pdf), block):
                part = pdf.iloc[at:at + block]
                z = np.hstack([np.ones((len(part), 1)), *[np.stack(part[c].to_numpy()).astype(np.float64) for c in cols]])
                if not np.isfinite(z).all():
                    raise ValueError("missing or non-finite values in a fit input")
                for key in part["_g"].unique():
                    rows = z[(part["_g"] == key).to_numpy()]
                    total[key] = total.get(key, 0.0) + rows.T @ rows
        for key, m in total.items():
            yield pd.DataFrame({"g": np.full(width, key, dtype=np.int32), "i": np.arange(width, dtype=np.int32), "v": [m[i, i:] for i in range(width)]})

    group = F.col(by).cast("int") if by else F.lit(-1)
    cores = df.sparkSession.sparkContext.defaultParallelism
    partials = df.select(group.alias("_g"), *cols).coalesce(cores).mapInPandas(partial, "g int, i int, v array<double>")
    summed = partials.groupBy("g", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    out: dict[int, np.ndarray] = {}
    for row in summed.toLocalIterator():  # groups x width rows
        m = out.setdefault(row.g, np.zeros((width, width)))
        m[row.i, row.i:] = m[row.i:, row.i] = row.v
    return out


class RidgeModel:
    """Coefficients (labels x width) and intercepts; small by construction."""

    def __init__(self, labels: list[str], coef: np.ndarray, intercept: np.ndarray):
        self.labels, self.coef, self.intercept = list(labels), coef, intercept

    def predict(self, design: DataFrame, sigmoid_once: bool = True) -> DataFrame:
        """(study_id, label, logit, prob) by one matrix product per Arrow batch."""
        coef, intercept, labels = self.coef, self.intercept, self.labels

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def linear(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(np.stack(x.to_numpy()) @ coef.T + intercept))

        scored = design.select("study_id", F.posexplode(linear("x")).alias("_l", "logit"))
        name = F.element_at(F.array(*[F.lit(v) for v in labels]), F.col("_l") + 1)
        prob = S.sigmoid("logit") if sigmoid_once else F.col("logit")
        return scored.select("study_id", name.alias("label"), "logit", prob.alias("prob"))


def ridge_fit(design: DataFrame, targets: DataFrame, labels: list[str], width: int, alpha: float = 1000.0, method: str = "normal",
              tolerance: float = 1e-10) -> RidgeModel:
    """Multi-output ridge with centred data and an unpenalised intercept:
    minimises ||y - Xw - b||^2 + alpha ||w||^2. design(study_id, x),
    targets(study_id, y array in label order).

    `normal` solves the width x width normal equations on the driver; `cg` takes
    conjugate-gradient steps, one pass over the pinned rows each, and holds vectors only.
    """
    n_out = len(labels)
    if method == "cg":
        return _ridge_cg(design.join(targets, "study_id"), labels, width, alpha, tolerance)
    if method != "normal":
        raise ValueError(method)
    g = gram_matrices(design.join(targets, "study_id"), ["x", "y"], 1 + width + n_out).get(-1)
    if g is None:
        raise ValueError("no rows to fit")
    n, sx, sy = g[0, 0], g[0, 1:1 + width], g[0, 1 + width:]
    mx, my = sx / n, sy / n
    xx = g[1:1 + width, 1:1 + width] - n * np.outer(mx, mx)
    xy = g[1:1 + width, 1 + width:] - n * np.outer(mx, my)
    low = np.linalg.cholesky(xx + alpha * np.eye(width))
    coef = np.linalg.solve(low.T, np.linalg.solve(low, xy)).T
    return RidgeModel(labels, coef, my - coef @ mx)


def _ridge_cg(df: DataFrame, labels: list[str], width: int, alpha: float, tolerance: float) -> RidgeModel:
    rows = pin(df.select("x", "y"))
    n_out, cores = len(labels), df.sparkSession.sparkContext.defaultParallelism

    def total(part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum over all rows of a vector per block of rows."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = None
            for pdf in batches:
                if len(pdf):
                    x, y = (np.stack(pdf[c].to_numpy()).astype(np.float64) for c in ("x", "y"))
                    if not (np.isfinite(x).all() and np.isfinite(y).all()):
                        raise ValueError("missing or non-finite values in a fit input")
                    v = part(x, y)
                    out = v if out is None else out + v
            if out is not None:
                yield pd.DataFrame({"v": [out]})

        found = rows.coalesce(cores).mapInPandas(run, "v array<double>").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).first()["v"]
        if not found:
            raise ValueError("no rows to fit")
        return np.array(found)

    sums = total(lambda x, y: np.concatenate([[len(x)], x.sum(0), y.sum(0)]))
    mx, my = sums[1:1 + width] / sums[0], sums[1 + width:] / sums[0]
    b = total(lambda x, y: ((x - mx).T @ (y - my)).ravel()).reshape(width, n_out)
    w, r = np.zeros_like(b), b.copy()
    p, rr = r.copy(), (r * r).sum(0)
    limit = (tolerance ** 2) * np.maximum(rr, 1e-300)
    for _ in range(2 * width):
        if (rr <= limit).all():
            break
        q = total(lambda x, y: ((x - mx).T @ ((x - mx) @ p)).ravel()).reshape(width, n_out) + alpha * p
        step = np.divide(rr, (p * q).sum(0), out=np.zeros_like(rr), where=rr > limit)
        w, r = w + step * p, r - step * q
        new = (r * r).sum(0)
        p, rr = r + np.divide(new, rr, out=np.zeros_like(rr), where=rr > limit) * p, new
    return RidgeModel(labels, w.T, my - w.T @ mx)


def target_logits(soft: DataFrame, labels: list[str], eps: float = 1e-4) -> DataFrame:
    """(study_id, y): logit of clipped soft targets in label order, from long form."""
    from .labels import pivot_labels
    wide = pivot_labels(soft, ["study_id"], labels, "p")
    return wide.select("study_id", F.array(*[S.logit(F.col(f"`{c}`"), eps) for c in labels]).alias("y"))


def train_eval_report(bank: DataFrame, soft: DataFrame, official: DataFrame, roles: DataFrame, labels: list[str], width: int,
                      slots: int = 6, alpha: float = 1000.0, pooled: DataFrame | None = None) -> DataFrame:
    """Two fits: gradient -> holdout (thresholded weak targets) and all weak -> gold
    (expert targets). Returns (phase, label, n_pos, n_neg, auc) with MACRO rows.

    Statistics, design and coefficients of a fit only see its own training ids.
    soft(study_id, label, p), official(study_id, label, y), roles(study_id, role).
    """
    # both phases read these several times: one pass over the bank, then a checkpoint
    pooled = pin(slot_mean_pool(bank) if pooled is None else pooled)
    # a silent label is undecided in a fit and not scored in the holdout
    targets = pin(target_logits(soft.withColumn("p", F.coalesce("p", S.dbl(0.5))), labels))
    pick = lambda *r: roles.filter(F.col("role").isin(*r)).select("study_id")
    phases = {"weak_holdout": (pick("gradient"), pick("holdout"), soft.filter("p IS NOT NULL").select("study_id", "label", S.binarize("p").alias("y"))),
              "production": (pick("gradient", "holdout"), pick("gold"), official)}
    report = None
    for phase, (train, test, truth) in phases.items():
        require_clean(expect_disjoint(train, test, ["study_id"], f"{phase}_leak"))
        stats = slot_stats(pooled, train, width, slots)
        design = slot_design(pooled, stats, width, slots)
        model = ridge_fit(design.join(train, "study_id", "left_semi"), targets, labels, slots * width + slots, alpha)
        scored = model.predict(design.join(test, "study_id", "left_semi")).join(truth, ["study_id", "label"])
        per = auc(scored, ["label"], "prob", "y")
        macro = macro_auc(per.withColumn("_all", F.lit(1)), ["_all"]).select(F.lit("MACRO").alias("label"), F.lit(None).cast("bigint").alias("n_pos"),
                                                                             F.lit(None).cast("bigint").alias("n_neg"), F.col("macro_auc").alias("auc"))
        rows = per.unionByName(macro).withColumn("phase", F.lit(phase))
        report = rows if report is None else report.unionByName(rows)
    return report


# ---- soft-label logistic ----------------------------------------------------------

def soft_logistic_fit(features: DataFrame, soft: DataFrame, labels: list[str], iterations: int = 50, reg: float = 0.0) -> dict:
    """One LogisticRegression per label on soft targets: each study counts as a
    positive of weight p and a negative of weight 1 - p. Fixed iteration budget,
    no selection on gold. features(study_id, pooled), soft(study_id, label, p)."""
    from pyspark.ml.classification import LogisticRegression
    x = features.select("study_id", array_to_vector("pooled").alias("features"))
    models = {}
    for label in labels:  # a fixed, short list
        rows = soft.filter((F.col("label") == label) & F.col("p").isNotNull()).join(x, "study_id")
        both = F.array(F.struct(S.dbl(1).alias("y"), F.col("p").alias("w")), F.struct(S.dbl(0).alias("y"), (S.dbl(1) - F.col("p")).alias("w")))
        data = rows.select("features", F.explode(both).alias("_t")).select("features", "_t.*").filter("w > 0")
        models[label] = LogisticRegression(labelCol="y", weightCol="w", maxIter=iterations, regParam=reg).fit(data)
    return models


def soft_logistic_predict(models: dict, features: DataFrame) -> DataFrame:
    x = features.select("study_id", array_to_vector("pooled").alias("features"))
    out = None
    for label, model in models.items():
        p = model.transform(x).select("study_id", F.lit(label).alias("label"), vector_to_array("probability")[1].alias("prob"),
                                      vector_to_array("rawPrediction")[1].alias("logit"))
        out = p if out is None else out.unionByName(p)
    return out


# ---- attention scoring ---------------------------------------------------------------

_ERF_AT = np.arange(-6 * 256, 6 * 256 + 1) / 256.0
_ERF = np.array([math.erf(x) for x in _ERF_AT])
_ERF_SLOPE = 2.0 / math.sqrt(math.pi) * np.exp(-_ERF_AT ** 2) / 256.0


def _erf(x: np.ndarray) -> np.ndarray:
    """Cubic Hermite interpolation over 256 knots per unit, within 1e-11; beyond 6 it is 1 or -1 in doubles."""
    at = (np.clip(x, -6.0, 6.0) + 6.0) * 256.0
    i = np.minimum(np.where(np.isnan(at), 0, at).astype(np.int64), len(_ERF) - 2)
    t = at - i
    a, b, c, d = _ERF[i], _ERF[i + 1], _ERF_SLOPE[i], _ERF_SLOPE[i + 1]
    return a + t * (c + t * (3.0 * (b - a) - 2.0 * c - d + t * (2.0 * (a - b) + c + d)))


def _gelu(x):
    return 0.5 * x * (1.0 + _erf(x / math.sqrt(2.0)))


def attention_score(bank: DataFrame, weights: dict[str, np.ndarray], classes: list[str], spine: DataFrame | None = None) -> DataFrame:
    """(study_id, class, logit) of a given attention head; a study of `spine` without vectors is an error.

    Per vector (Arrow batches): layer norm, linear, GELU, plus slot and position
    embedding, tanh scorer. Pooling over a study and the class product run in SQL.
    Keys: norm_w, norm_b, proj_w, proj_b, slot, pos1_w, pos1_b, pos2_w, pos2_b,
    att1_w, att1_b, att2_w, att2_b, class_w, class_b.
    """
    W = {k: np.asarray(v, dtype=np.float64) for k, v in weights.items()}

    @F.pandas_udf("struct<h: array<double>, s: array<double>>")
    def tokens(e: pd.Series, slot: pd.Series, position: pd.Series) -> pd.DataFrame:
        if not len(e):
            return pd.DataFrame({"h": [], "s": []})
        x = np.stack(e.to_numpy()).astype(np.float64)
        x = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5) * W["norm_w"] + W["norm_b"]
        h = _gelu(x @ W["proj_w"].T + W["proj_b"]) + W["slot"][slot.to_numpy().astype(int)]
        p = position.to_numpy().astype(np.float64)[:, None]
        h = h + _gelu(p @ W["pos1_w"].T + W["pos1_b"]) @ W["pos2_w"].T + W["pos2_b"]
        s = np.tanh(h @ W["att1_w"].T + W["att1_b"]) @ W["att2_w"].T + W["att2_b"]
        return pd.DataFrame({"h": list(h), "s": list(s)})

    made = bank.select("study_id", tokens("embedding", "slot", "position").alias("_t"))
    scored = made.select("study_id", F.col("_t.h").alias("embedding"), *[F.col("_t.s")[i].alias(c) for i, c in enumerate(classes)])
    pooled = attention_pool(scored, classes, spine)
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class"))
    rows = F.array(*[F.array(*[S.dbl(v) for v in W["class_w"][i]]) for i in range(len(classes))])
    bias = F.array(*[S.dbl(v) for v in W["class_b"]])
    return pooled.select("study_id", "class", (S.dot("pooled", F.element_at(rows, at.cast("int"))) + F.element_at(bias, at.cast("int"))).alias("logit"))


def batch_embed(slices: DataFrame, make_predict: Callable, shape: list[int], width: int, batch_size: int = 16,
                pixels: str = "pixels") -> DataFrame:
    """Encode existing slice rows with a caller-supplied model, in fixed batches.

    make_predict() is called once per Python worker and returns a function from
    float32 arrays (batch, *shape) to (batch, width). Bad output fails the job.
    """
    def checked():
        model = make_predict()

        def run(inputs: np.ndarray) -> np.ndarray:
            out = np.asarray(model(inputs), dtype=np.float32)
            if out.shape != (len(inputs), width) or not np.isfinite(out).all():
                raise ValueError("encoder output has another shape or is not finite")
            return out
        return run

    encode = predict_batch_udf(checked, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, input_tensor_shapes=[shape])
    return slices.withColumn("embedding", encode(F.col(pixels))).drop(pixels)


# ---- spectrum ------------------------------------------------------------------------

def covariance_spectrum(bank: DataFrame, width: int, by_slot: bool = True) -> DataFrame:
    """(scope, slot, n, top1, top10, effective_rank) of the centred covariance, overall
    and per slot from one pass over the bank.

    effective_rank = exp(entropy of the normalised eigenvalues).
    """
    per = gram_matrices(bank, ["embedding"], 1 + width, "slot")
    scopes = [("all", -1, sum(per.values()))] + ([("slot", s, per[s]) for s in sorted(per)] if by_slot else [])
    rows = []
    for scope, slot, g in scopes:
        n = g[0, 0]
        mean = g[0, 1:] / n
        values = np.clip(np.linalg.eigvalsh(g[1:, 1:] / n - np.outer(mean, mean))[::-1], 0, None)
        share = values / values.sum() if values.sum() > 0 else values
        positive = share[share > 0]
        rows.append((scope, int(slot), int(n), float(share[0]), float(share[:10].sum()), float(np.exp(-(positive * np.log(positive)).sum()))))
    return bank.sparkSession.createDataFrame(rows, "scope string, slot int, n bigint, top1 double, top10 double, effective_rank double")


# ---- replays ---------------------------------------------------------------------------

def replay_check(saved: DataFrame, recomputed: DataFrame, atol: float = 1e-6, rtol: float = 0.0, value: str = "prob") -> DataFrame:
    """One row: coverage, largest difference and verdict of two prediction tables on
    (study_id, label). |new - saved| <= atol + rtol * |saved| everywhere."""
    s = saved.groupBy("study_id", "label").agg(F.max(value).alias("_s"), F.count(F.lit(1)).alias("_cs"))
    r = recomputed.groupBy("study_id", "label").agg(F.max(value).alias("_r"), F.count(F.lit(1)).alias("_cr"))
    both = s.join(r, ["study_id", "label"], "full")
    missing = F.col("_cs").isNull() | F.col("_cr").isNull()
    near = F.coalesce(S.is_close("_r", "_s", rtol, atol, symmetric=False), F.lit(False))
    out = both.agg(F.count("_cs").alias("n_saved"), F.count("_cr").alias("n_replayed"), F.count_if(missing).alias("uncovered"),
                   F.count_if(F.coalesce((F.col("_cs") > 1) | (F.col("_cr") > 1), F.lit(False))).alias("duplicates"),
                   F.max(F.abs(F.col("_r") - F.col("_s"))).alias("max_abs_difference"), F.count_if(~missing & ~near).alias("outside"))
    return out.withColumn("matches", (F.col("uncovered") == 0) & (F.col("duplicates") == 0) & (F.col("outside") == 0))


def metric_check(saved: DataFrame, recomputed: DataFrame, keys: list[str], value: str = "auc", atol: float = 1e-12) -> DataFrame:
    """Saved metrics against recomputed ones; both undefined counts as equal."""
    both = saved.select(*keys, F.col(value).alias("_s")).join(recomputed.select(*keys, F.col(value).alias("_r")), keys, "full")
    same = (F.col("_s").isNull() & F.col("_r").isNull()) | F.coalesce(S.is_close("_r", "_s", 0.0, atol, symmetric=False), F.lit(False))
    return both.withColumn("same", same)


def controlled_comparison(runs: DataFrame, pairs: DataFrame, allowed: list[str], metrics: DataFrame) -> DataFrame:
    """Metric differences of run pairs whose configs differ in the allowed keys only
    and whose bank digest and id digest agree. runs(run_id, config, bank_digest,
    ids_digest), metrics(run_id, population, label, auc)."""
    from .checks import config_diff
    gate = config_diff(runs, pairs, allowed).filter("allowed").select("left_run", "right_run")
    side = lambda run, tag: runs.select(F.col("run_id").alias(run), F.col("bank_digest").alias(f"_b{tag}"), F.col("ids_digest").alias(f"_i{tag}"))
    gate = gate.join(side("left_run", 0), "left_run").join(side("right_run", 1), "right_run").filter("_b0 = _b1 AND _i0 = _i1")
    m = lambda run, name: metrics.select(F.col("run_id").alias(run), "population", "label", F.col("auc").alias(name))
    left = gate.join(m("left_run", "auc_left"), "left_run")
    return left.join(m("right_run", "auc_right"), ["right_run", "population", "label"]).select(
        "left_run", "right_run", "population", "label", "auc_left", "auc_right", (F.col("auc_right") - F.col("auc_left")).alias("delta"))

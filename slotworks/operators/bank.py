"""Feature banks in long form: pooling, statistics, duplicates, merge, resume.

A bank row is (study_id, slot, k, position, series_id, shard, identity,
embedding). An absent slot has no rows. Vector aggregates use ML's Summarizer,
whose d-wide buffers combine map-side, instead of exploding d rows per vector.
"""
from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .checks import rule_table
from .ordering import bucket_bits, exact_quantiles, with_hash_ordinal

FIVE = {"q_min": 0.0, "q05": 0.05, "median": 0.5, "q95": 0.95, "q_max": 1.0}


def vec(c="embedding") -> Column:
    return array_to_vector(S.col(c))


def arr(c) -> Column:
    return vector_to_array(c)


def explode_dims(df: DataFrame, keys: list[str], vectors: dict[str, str]) -> DataFrame:
    """Long form (keys, dim, one column per vector) of fixed-width array columns."""
    names = list(vectors)
    zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in vectors.items()])
    return df.select(*keys, F.posexplode(zipped).alias("dim", "_v")).select(*keys, "dim", *[f"_v.{n}" for n in names])


# ---- pooling ----------------------------------------------------------------

def slot_mean_pool(bank: DataFrame) -> DataFrame:
    """(study, slot, pooled): mean over the K vectors of a slot."""
    return bank.groupBy("study_id", "slot").agg(arr(Summarizer.mean(vec())).alias("pooled"))


def meanmax_pool(bank: DataFrame) -> DataFrame:
    """(study, mean, max, pooled) over every present vector of a study."""
    pooled = bank.groupBy("study_id").agg(arr(Summarizer.mean(vec())).alias("mean"), arr(Summarizer.max(vec())).alias("max"))
    return pooled.withColumn("pooled", F.concat("mean", "max"))


def attention_pool(scored: DataFrame, classes: list[str], spine: DataFrame | None, width: int | None = None) -> DataFrame:
    """(study, class, pooled): softmax of the class score over a study's vectors.

    scored is the bank with one score column per class. All classes share one
    aggregation, so vectors are shuffled once, not once per class. A study of
    `spine` without rows is an error when the result is read, unless `width` is
    given: then it pools absent vectors uniformly, which is a zero vector. `spine`
    None says that the studies are those of `scored`.
    """
    top = scored.groupBy("study_id").agg(*[F.max(c).alias(f"_top_{i}") for i, c in enumerate(classes)])
    joined = scored.join(top, "study_id")
    weights = [F.exp(F.col(c).cast("double") - F.col(f"_top_{i}").cast("double")) for i, c in enumerate(classes)]
    pooled = joined.groupBy("study_id").agg(*[arr(Summarizer.mean(vec(), w)).alias(f"_p{i}") for i, w in enumerate(weights)])
    if spine is not None:
        absent = F.raise_error(F.concat(F.lit("no vectors of study "), F.coalesce(F.col("study_id").cast("string"), F.lit("NULL")))).cast("array<double>")
        empty = absent if width is None else F.array_repeat(S.dbl(0), width)
        pooled = spine.select("study_id").distinct().join(pooled, "study_id", "left")
        pooled = pooled.select("study_id", *[F.coalesce(f"_p{i}", empty).alias(f"_p{i}") for i in range(len(classes))])
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"_p{i}").alias("pooled")) for i, c in enumerate(classes)])
    return pooled.select("study_id", F.explode(rows).alias("r")).select("study_id", "r.*")


# ---- statistics -------------------------------------------------------------

def population_std(std: Column, n: Column) -> Column:
    """Summarizer gives the sample deviation; rescale it to the population one."""
    scale = F.sqrt((n - 1).cast("double") / n.cast("double"))
    return F.transform(arr(std), lambda x: x * scale)


def slot_stats(pooled: DataFrame, fit_ids: DataFrame, width: int, slots: int = 6, floor: float = 0.001) -> DataFrame:
    """(slot, n, mean, std) over the fit ids only; std floored; an unobserved slot
    has mean 0 and std = floor."""
    seen = (pooled.join(fit_ids.select("study_id").distinct(), "study_id", "left_semi").groupBy("slot")
            .agg(Summarizer.mean(vec("pooled")).alias("_m"), Summarizer.std(vec("pooled")).alias("_s"), F.count(F.lit(1)).alias("n")))
    seen = seen.select("slot", "n", arr("_m").alias("mean"), population_std(F.col("_s"), F.col("n")).alias("std"))
    every = pooled.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(seen, "slot", "left").select(
        "slot", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.array_repeat(S.dbl(0), width)).alias("mean"),
        F.transform(F.coalesce("std", F.array_repeat(S.dbl(0), width)), lambda x: F.greatest(x, S.dbl(floor))).alias("std"))


def bank_summary(bank: DataFrame) -> DataFrame:
    """Studies, selected slots, images and duplicate (study, slot, k) rows."""
    per_image = bank.groupBy("study_id", "slot", "k").agg(F.count(F.lit(1)).alias("c"))
    per_slot = per_image.groupBy("study_id", "slot").agg(F.sum("c").alias("images"), F.sum(F.col("c") - 1).alias("extra"))
    per_study = per_slot.groupBy("study_id").agg(F.count(F.lit(1)).alias("slots"), F.sum("images").alias("images"), F.sum("extra").alias("extra"))
    return per_study.agg(F.count(F.lit(1)).alias("studies"), F.sum("slots").alias("selected_slots"),
                         F.sum("images").alias("images"), F.sum("extra").alias("duplicates"))


def mask_patterns(bank: DataFrame, slots: int = 6) -> DataFrame:
    """(kind, key, n): pattern histogram, studies per slot, studies by slot count.

    The last two come from the pattern table (at most 2^slots rows).
    """
    bits = bank.groupBy("study_id").agg(F.bit_or(F.expr("shiftleft(1, slot)")).alias("bits"))
    has = lambda i: F.expr(f"shiftright(bits, {i})").bitwiseAND(1)
    pattern = F.concat(*[has(i).cast("string") for i in range(slots)])
    counts = bits.groupBy(pattern.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    on = lambda i: F.substring("key", i + 1, 1) == "1"
    slot = counts.select(F.explode(F.array(*[F.when(on(i), F.lit(i)) for i in range(slots)])).alias("s"), "n")
    slot = slot.filter("s IS NOT NULL").groupBy(F.col("s").cast("string").alias("key")).agg(F.sum("n").alias("n"))
    width = F.length(F.replace("key", F.lit("0"), F.lit(""))).cast("string")
    size = counts.groupBy(width.alias("key")).agg(F.sum("n").alias("n"))
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "key", "n")
    return tag(counts, "pattern").unionByName(tag(slot, "slot")).unionByName(tag(size, "slots_per_study"))


def norm_stats(bank: DataFrame) -> DataFrame:
    """(metric, value): L2-norm quantiles, zero vectors and the largest magnitude."""
    norms = bank.select(S.l2_norm("embedding").alias("norm"), S.max_abs("embedding").alias("peak"))
    q = exact_quantiles(norms.select("norm"), [], "norm", FIVE)
    rest = norms.agg(F.count_if(F.col("norm") == 0).cast("double").alias("zero_vectors"), F.max("peak").alias("max_abs"))
    tidy = lambda df, cols: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in cols])).alias("r")).select("r.*")
    return tidy(q, list(FIVE)).unionByName(tidy(rest, ["zero_vectors", "max_abs"]))


def dim_std_stats(bank: DataFrame) -> DataFrame:
    """Spread of the per-dimension deviation over dimensions: all vectors, per slot,
    and of study means. One row per scope; the second stage sees d numbers each."""
    def spread(df, scope, by, vector):
        s = df.groupBy(*by).agg(Summarizer.std(vec(vector)).alias("_s"), F.count(F.lit(1)).alias("_n"))
        dims = s.select(*by, F.explode(population_std(F.col("_s"), F.col("_n"))).alias("sd"))
        slot = F.col("slot").cast("int") if by else F.lit(-1)
        q = F.percentile("sd", F.array(*[S.dbl(v) for v in FIVE.values()]))
        out = dims.groupBy(slot.alias("slot")).agg(q.alias("_q"), F.count_if(F.col("sd") == 0).alias("constant_dims"))
        return out.select(F.lit(scope).alias("scope"), "slot", *[F.col("_q")[i].alias(n) for i, n in enumerate(FIVE)], "constant_dims")

    means = bank.groupBy("study_id").agg(arr(Summarizer.mean(vec())).alias("mean"))
    return (spread(bank, "all", [], "embedding").unionByName(spread(bank, "slot", ["slot"], "embedding"))
            .unionByName(spread(means, "study_mean", [], "mean")))


def hash_pairs(df: DataFrame, id_cols: list[str], vector: str, seed: int, by: list[str] = (), pairs: int | None = None,
               bits: int = 12) -> DataFrame:
    """Disjoint pseudo-random pairs and their cosine: neighbours 2i, 2i+1 in hash
    order. Every row is in at most one pair; `pairs` keeps the first ones per group."""
    h = df.withColumn("_h", S.hash_bits(F.lit(seed), *id_cols))
    o = with_hash_ordinal(h, "_h", list(id_cols), "_o", bits, list(by)).withColumn("_pair", F.floor(F.col("_o") / 2))
    if pairs is not None:
        o = o.filter(F.col("_pair") < pairs)
    left = o.filter(F.col("_o") % 2 == 0).select(*by, "_pair", F.col(vector).alias("_a"))
    right = o.filter(F.col("_o") % 2 == 1).select(*by, "_pair", F.col(vector).alias("_b"))
    return left.join(right, [*by, "_pair"]).select(*by, "_pair", S.cosine("_a", "_b").alias("cosine"))


def cosine_sample(bank: DataFrame, seed: int = 20261007, pairs: int | None = 8192) -> DataFrame:
    """Cosine quantiles: across all vectors, inside each slot, and of study means."""
    ids = ["study_id", "slot", "k"]
    bits = bucket_bits(bank.count())
    means = bank.groupBy("study_id").agg(arr(Summarizer.mean(vec())).alias("mean"))
    parts = {"cross_slice": hash_pairs(bank, ids, "embedding", seed, [], pairs, bits).select(F.lit(-1).alias("slot"), "cosine"),
             "same_slot": hash_pairs(bank, ids, "embedding", seed, ["slot"], pairs, bits).select(F.col("slot").cast("int").alias("slot"), "cosine"),
             "study_pair": hash_pairs(means, ["study_id"], "mean", seed).select(F.lit(-1).alias("slot"), "cosine")}
    rows = None
    for scope, df in parts.items():
        tagged = df.withColumn("scope", F.lit(scope))
        rows = tagged if rows is None else rows.unionByName(tagged)
    return exact_quantiles(rows, ["scope", "slot"], "cosine", FIVE)


def consecutive_cosine(bank: DataFrame) -> DataFrame:
    """Cosine of successive vectors of a (study, slot), met by an equi-join on k."""
    later = bank.select("study_id", "slot", (F.col("k") - 1).alias("k"), F.col("embedding").alias("_next"))
    return bank.select("study_id", "slot", "k", "embedding").join(later, ["study_id", "slot", "k"]).select(
        "study_id", "slot", "k", S.cosine("embedding", "_next").alias("cosine"))


def vector_duplicates(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: distinct vectors, duplicate groups and the rows in them.

    Vectors are compared by 128 bits of hash over their numbers, their length and
    the places of their NULLs; -0.0 equals 0.0, and all NaN are one value.
    """
    seeded = lambda seed: F.xxhash64(F.lit(seed), F.col(vector), F.size(vector), F.transform(vector, lambda x: x.isNull()))
    per = df.groupBy(seeded(1).alias("_h"), seeded(2).alias("_g")).agg(F.count(F.lit(1)).alias("c"))
    many = F.col("c") > 1
    return per.agg(F.count(F.lit(1)).alias("distinct_vectors"), F.count_if(many).alias("duplicate_groups"),
                   F.coalesce(F.sum(F.when(many, F.col("c"))), F.lit(0)).alias("rows_in_groups"))


# ---- merge and resume ---------------------------------------------------------

def merge_rules(plan: DataFrame, partials: DataFrame, identity: str) -> DataFrame:
    """Violations of 'every planned (study, slot, k) exactly once, from its owner'."""
    keys = ["study_id", "slot", "k"]
    got = partials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("c"), F.min("shard").alias("s0"), F.max("shard").alias("s1"),
        F.min("series_id").alias("r0"), F.max("series_id").alias("r1"), F.min("position").alias("p0"),
        F.max("position").alias("p1"), F.count_if(~F.col("identity").eqNullSafe(F.lit(identity))).alias("other"))
    want = plan.select(*keys, F.col("series_id").alias("want_series"), F.col("shard").alias("want_shard"), F.col("position").alias("want_position"))
    both = want.join(got, keys, "full")
    planned, present = F.col("want_series").isNotNull(), F.col("c").isNotNull()
    differs = lambda lo, hi, w: planned & present & ~(F.col(lo).eqNullSafe(F.col(w)) & F.col(hi).eqNullSafe(F.col(w)))
    return rule_table(both, F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), {
        "missing": ~present, "unexpected": ~planned, "overlap": F.col("c") > 1, "wrong_shard": differs("s0", "s1", "want_shard"),
        "wrong_series": differs("r0", "r1", "want_series"), "wrong_position": differs("p0", "p1", "want_position"),
        "other_identity": F.col("other") > 0})


def merge_partials(plan: DataFrame, partials: DataFrame, identity: str) -> DataFrame:
    """The merged bank. All rules are evaluated before any row is handed out."""
    from .checks import require_clean
    require_clean(merge_rules(plan, partials, identity))
    return partials.select("study_id", "slot", "k", "position", "series_id", "shard", "identity", "embedding")


def pending_ids(plan: DataFrame, done: DataFrame, identity: str, key: str = "study_id") -> DataFrame:
    """Ids still to do: planned, and not finished under this identity."""
    finished = done.filter(F.col("identity").eqNullSafe(F.lit(identity))).select(key).distinct()
    return plan.select(key).distinct().join(finished, key, "left_anti")


def expect_same_identity(done: DataFrame, identity: str, key: str = "study_id") -> DataFrame:
    """Rows of another extraction are an error, never 'done'."""
    return rule_table(done, key, {"other_identity": ~F.col("identity").eqNullSafe(F.lit(identity))})

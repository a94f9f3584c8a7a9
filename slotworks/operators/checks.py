"""Expectations: each returns rows (rule, n_violations, sample_key).

A table is read once for all of its rules, and nothing is raised until
`require_clean` is called on the (rule-sized) result.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

STRICT_ID = r"^\d+(\.\d+)*$"
LOOSE_ID = r"^[0-9.]+$"


def rule_table(df: DataFrame, key, rules: dict[str, Column]) -> DataFrame:
    """Count the rows where each rule's violation expression is true."""
    text = S.col(key).cast("string")
    aggs, rows = [], []
    for i, (name, bad) in enumerate(rules.items()):
        bad = F.coalesce(bad, F.lit(False))
        aggs += [F.count_if(bad).alias(f"n{i}"), F.min(F.when(bad, text)).alias(f"k{i}")]
        rows.append(F.struct(F.lit(name).alias("rule"), F.col(f"n{i}").alias("n_violations"),
                             F.col(f"k{i}").alias("sample_key")))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def require_clean(rules: DataFrame) -> None:
    bad = rules.filter("n_violations > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r.rule}: {r.n_violations} (e.g. {r.sample_key})" for r in bad))


# ---- labels -----------------------------------------------------------------

def gold_flag(df: DataFrame, labels: list[str], out: str = "is_gold") -> DataFrame:
    return df.withColumn(out, reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in labels]))


def expect_all_or_none(df: DataFrame, key: str, labels: list[str]) -> DataFrame:
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in labels])
    return rule_table(df, key, {"partial_labels": ~nulls.isin(0, len(labels))})


def expect_probability(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """NULL, NaN, infinite and out-of-range values are separate rules per column."""
    rules = {}
    for c in cols:
        x = F.col(c).cast("double")
        finite = S.is_finite(x)
        rules[f"{c}:null"] = x.isNull()
        rules[f"{c}:nan"] = F.isnan(x)
        rules[f"{c}:infinite"] = ~F.isnan(x) & (F.abs(x) == S.dbl("inf"))
        rules[f"{c}:range"] = finite & ((x < 0) | (x > 1))
    return rule_table(df, key, rules)


def expect_ids(df: DataFrame, key: str, pattern: str = STRICT_ID) -> DataFrame:
    """Non-null, pattern and uniqueness. Counting per id combines map-side, so a
    repeated id costs one row per task."""
    per_id = df.groupBy(F.col(key).cast("string").alias("_id")).count()
    i, n = F.col("_id"), F.col("count")
    rules = {"null_id": F.when(i.isNull(), n), "bad_pattern": F.when(~i.rlike(pattern), n),
             "duplicate_id": F.when(i.isNotNull() & (n > 1), n - 1)}
    one = per_id.agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("bigint").alias(r) for r, v in rules.items()],
                     *[F.min(F.when(v.isNotNull(), i)).alias(f"{r}_key") for r, v in rules.items()])
    rows = [F.struct(F.lit(r).alias("rule"), F.col(r).alias("n_violations"), F.col(f"{r}_key").alias("sample_key"))
            for r in rules]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ---- contracts --------------------------------------------------------------

def schema_contract(df: DataFrame, spec: T.StructType) -> DataFrame:
    """Exact names, order, types and no duplicate columns. Metadata only."""
    names = [f.name for f in df.schema]
    types = {f.name: f.dataType for f in df.schema}
    found = {
        "duplicate_columns": sorted({n for n in names if names.count(n) > 1}),
        "missing_columns": [f.name for f in spec if f.name not in types],
        "unexpected_columns": [n for n in names if n not in spec.names],
        "column_order": [] if [n for n in names if n in spec.names] == [n for n in spec.names if n in types] else ["order"],
        "column_types": [f.name for f in spec if f.name in types and types[f.name] != f.dataType],
    }
    rows = [(rule, len(bad), bad[0] if bad else None) for rule, bad in found.items()]
    return df.sparkSession.createDataFrame(rows, "rule string, n_violations bigint, sample_key string")


def split_roles(df: DataFrame, holdout_fold: int, gold: str = "is_gold", fold: str = "fold",
                n_folds: int = 5) -> DataFrame:
    """role = gold | holdout | gradient; a weak row outside the folds is 'invalid'."""
    f = F.col(fold)
    return df.withColumn("role", F.when(F.col(gold), "gold")
                         .when(f.isNull() | ~f.between(0, n_folds - 1), "invalid")
                         .when(f == holdout_fold, "holdout").otherwise("gradient"))


def expect_roles(roles: DataFrame, key: str) -> DataFrame:
    """Folds valid, holdout not empty, and every id in one role only."""
    per_id = roles.groupBy(key).agg(F.min("role").alias("_a"), F.max("role").alias("_b"))
    rules = rule_table(per_id, key, {"two_roles": F.col("_a") != F.col("_b"), "invalid_fold": F.col("_b") == "invalid"})
    empty = roles.agg((1 - F.max(F.coalesce(F.col("role") == "holdout", F.lit(False)).cast("int"))).cast("bigint").alias("n_violations"))
    return rules.unionByName(empty.select(F.lit("empty_holdout").alias("rule"), F.coalesce("n_violations", F.lit(1).cast("bigint")).alias("n_violations"),
                                          F.lit(None).cast("string").alias("sample_key")))


def bank_geometry(bank: DataFrame, planned: DataFrame | None = None, width: int = 1024, k: int = 4,
                  slots: int = 6) -> DataFrame:
    """Width, finite values and positions, slot and k range, non-empty series id.

    In long form an absent slot has no rows; a NULL-embedding row must therefore
    carry neither a series nor a non-zero position.
    """
    e, p = F.col("embedding"), F.col("position").cast("double")
    present = e.isNotNull()
    named = F.coalesce(F.col("series_id") != "", F.lit(False))
    return rule_table(bank, F.concat_ws("/", "study_id", "slot", "k"), {
        "width": present & (F.size(e) != width),
        "non_finite": present & ~S.finite_all(e),
        "position_range": ~S.is_finite(p) | (p < 0) | (p > 1),
        "absent_position": ~present & (p != 0),
        "mask_series": present != named,
        "slot_range": ~F.col("slot").between(0, slots - 1),
        "k_range": ~F.col("k").between(0, k - 1),
    })


def config_diff(runs: DataFrame, pairs: DataFrame, allowed: list[str]) -> DataFrame:
    """Compare config maps of run pairs: one row per pair.

    runs(run_id, config MAP<STRING,STRING>), pairs(left_run, right_run). Key sets
    must be equal and the changed keys must be exactly `allowed`.
    """
    side = lambda run, tag: runs.select(F.col("run_id").alias(run), F.col("config").alias(tag))
    both = pairs.join(side("left_run", "_a"), "left_run").join(side("right_run", "_b"), "right_run")
    keys_a, keys_b = F.array_sort(F.map_keys("_a")), F.array_sort(F.map_keys("_b"))
    changed = F.array_sort(F.filter(F.array_intersect(keys_a, keys_b),
                                    lambda k: ~F.element_at("_a", k).eqNullSafe(F.element_at("_b", k))))
    want = F.array_sort(F.array(*[F.lit(a) for a in allowed]))
    return both.select("left_run", "right_run", (keys_a == keys_b).alias("same_keys"),
                       F.array_join(changed, ",").alias("changed"),
                       ((keys_a == keys_b) & (changed == want)).alias("allowed"))


def expect_url_policy(df: DataFrame, key: str, url: str, hosts: list[str], suffix: bool = False) -> DataFrame:
    """https, listed host (or host suffix), no user info and no fragment."""
    part = lambda name: F.expr(f"try_parse_url(`{url}`, '{name}')")
    host = F.lower(part("HOST"))
    listed = reduce(lambda a, b: a | b, [(host == h) | host.endswith("." + h) for h in hosts]) if suffix else host.isin(hosts)
    return rule_table(df, key, {
        "scheme": F.coalesce(part("PROTOCOL"), F.lit("")) != "https",
        "host": ~F.coalesce(listed, F.lit(False)),
        "user_info": part("USERINFO").isNotNull(),
        "fragment": part("REF").isNotNull(),
    })


def expect_job_fields(df: DataFrame, key: str, filename: str, max_bytes: int = 11_000_000_000,
                      seconds: tuple[int, int] = (1, 7200)) -> DataFrame:
    b, s = F.col("expected_bytes"), F.coalesce("max_seconds", F.lit(1800))
    return rule_table(df, key, {
        "job_id": ~F.coalesce(F.col("job_id").rlike(r"^shard_[0-6]$"), F.lit(False)),
        "filename": ~F.col("filename").eqNullSafe(F.lit(filename)),
        "bytes": b.isNull() | (b <= 0) | (b > max_bytes),
        "sha256": ~S.is_hex("expected_sha256", 64),
        "time_budget": ~s.between(*seconds),
        "same_endpoint": F.col("read_url").eqNullSafe(F.col("put_url")),
    })


def freshness_gate(df: DataFrame, now, max_age: float = 900, reserve: float = 1500) -> DataFrame:
    """Adds `fresh`: recent receipt, required covers runtime + reserve, enough available."""
    age = S.col(now) - F.col("observed")
    ok = (age.between(0, max_age) & (F.col("required") >= F.col("runtime") + reserve)
          & (F.col("available") >= F.col("required")))
    return df.withColumn("fresh", F.coalesce(ok, F.lit(False)))


def expect_history(history: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: epochs 1..E once each, updates = epoch * ceil(n / batch), finite loss.

    history(run_id, epoch, updates, loss), runs(run_id, epochs, n, batch).
    """
    steps = F.ceil(F.col("n") / F.col("batch"))
    seen = history.groupBy("run_id", "epoch").agg(
        F.count(F.lit(1)).alias("c"), F.min("updates").alias("u0"), F.max("updates").alias("u1"),
        F.count_if(~S.is_finite("loss")).alias("bad"))
    joined = runs.select("run_id", "epochs", steps.alias("steps")).join(seen, "run_id", "left")
    return joined.groupBy("run_id", "epochs").agg(
        (F.count_if(F.col("epoch").between(1, F.col("epochs")) & (F.col("c") == 1)) == F.max("epochs")).alias("epochs_ok"),
        (F.count_if(F.coalesce((F.col("u0") != F.col("epoch") * F.col("steps")) | (F.col("u1") != F.col("u0"))
                               | ~F.col("epoch").between(1, F.col("epochs")), F.lit(False))) == 0).alias("updates_ok"),
        (F.coalesce(F.sum("bad"), F.lit(0)) == 0).alias("loss_ok"))


# ---- keys and sets ----------------------------------------------------------

def coverage_report(expected: DataFrame, actual: DataFrame, keys: list[str], ordinal: str | None = None) -> DataFrame:
    """missing / unexpected / duplicate keys, and out_of_order with `ordinal`.

    Both sides are reduced to one row per key before they meet.
    """
    def side(df, tag):
        aggs = [F.count(F.lit(1)).alias(f"_{tag}")]
        if ordinal:
            aggs.append(F.min(ordinal).alias(f"_{tag}_ord"))
        return df.groupBy(*keys).agg(*aggs)

    both = side(expected, "e").join(side(actual, "a"), keys, "full")
    e, a = F.coalesce("_e", F.lit(0)), F.coalesce("_a", F.lit(0))
    rules = {"missing": a == 0, "unexpected": e == 0, "duplicate": (e > 1) | (a > 1)}
    if ordinal:
        rules["out_of_order"] = F.col("_e_ord") != F.col("_a_ord")
    return rule_table(both, F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), rules)


def expect_disjoint(a: DataFrame, b: DataFrame, keys: list[str], rule: str = "overlap") -> DataFrame:
    shared = a.select(*keys).join(b.select(*keys), keys, "left_semi").groupBy(*keys).count()
    return rule_table(shared, F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), {rule: F.lit(True)})


def expect_mapping(child: DataFrame, parent: DataFrame, key: str, value: str) -> DataFrame:
    """Both tables must pair `key` with the same `value` (e.g. series with study)."""
    one = lambda df, tag: df.groupBy(key).agg(F.min(value).alias(f"_{tag}0"), F.max(value).alias(f"_{tag}1"))
    both = one(child, "c").join(one(parent, "p"), key)
    return rule_table(both, key, {"mapping_differs": ~((F.col("_c0") == F.col("_p0")) & (F.col("_c1") == F.col("_p1"))
                                                      & (F.col("_c0") == F.col("_c1")))})


def set_relation(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: sizes of the key sets, and the equal / subset / disjoint predicates."""
    tag = lambda df, name: df.groupBy(*keys).agg(F.lit(1).alias(name))
    both = tag(a, "_a").join(tag(b, "_b"), keys, "full")
    n = both.agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"),
                 F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"))
    return n.select("*", ((F.col("n_a") == F.col("n_both")) & (F.col("n_b") == F.col("n_both"))).alias("equal"),
                    (F.col("n_a") == F.col("n_both")).alias("a_subset_b"), (F.col("n_both") == 0).alias("disjoint"))


def restrict_to_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def complete_groups(expected: DataFrame, present: DataFrame, group: str, member: str) -> DataFrame:
    """Groups whose every expected member is present (two anti-joins, no sets)."""
    missing = expected.join(present.select(member), member, "left_anti").select(group).distinct()
    return expected.select(group).distinct().join(missing, group, "left_anti")


def pilot_subset(df: DataFrame, key: str, n: int, gold: str = "is_gold") -> DataFrame:
    """First n weak ids in sorted order; a distributed top-k."""
    return df.filter(~F.col(gold)).select(key).orderBy(key).limit(n)


def sorted_ids(df: DataFrame, key: str) -> DataFrame:
    """Distinct ids in codepoint order (range-partitioned sort)."""
    return df.select(key).distinct().orderBy(key)

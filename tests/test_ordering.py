import numpy as np
import pytest
from pyspark.sql import functions as F

from slotworks.functions import scalars as S
from slotworks.operators import ordering as O


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows share one key; many ties."""
    rng = np.random.default_rng(1)
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 17}", float(np.round(rng.normal(), 1)), i % 5) for i in range(3000)]
    return spark.createDataFrame(rows, "id bigint, g string, v double, w bigint")


def groups(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r["g"], []).append(tuple(r[c] for c in cols))
    return out


def test_hot_group_numbering_equals_window(hot):
    order = [F.col("v").desc(), F.col("id").asc()]
    plain = O.with_row_number(hot, ["g"], order, "rn")
    ranged = O.with_row_number(hot, ["g"], order, "rn", hot_rows=100)
    assert {(r.id, r.rn) for r in plain.collect()} == {(r.id, r.rn) for r in ranged.collect()}
    whole = O.with_row_number(hot, [], order, "rn", hot_rows=100)
    assert sorted(r.rn for r in whole.collect()) == list(range(1, 3001))


def test_numbering_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [("a", i) for i in range(50)], "g string, id bigint")
    got = O.with_row_number(df, ["g"], [F.col("id").asc()], "rn", hot_rows=5)
    assert got.count() == 100 and got.filter("rn != id + 1").count() == 0


def test_running_totals_and_ranks(hot):
    got = groups(O.with_average_rank(hot, ["g"], "v"), "id", "v", "rank", "rank_n")
    for rows in got.values():
        v = np.array([r[1] for r in rows])
        want = [(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]
        assert [r[2] for r in rows] == want and all(r[3] == len(v) for r in rows)


def test_exact_quantiles(hot):
    got = O.exact_quantiles(hot, ["g"], "v", {"a": 0.01, "b": 0.5, "c": 0.995}).collect()
    values = groups(hot, "v")
    assert len(got) == len(values)
    for r in got:
        v = np.array([x[0] for x in values[r["g"]]])
        assert np.allclose([r["a"], r["b"], r["c"]], np.quantile(v, [0.01, 0.5, 0.995])) and r["n_values"] == len(v)


def test_quantiles_of_extreme_values(spark):
    v = [-1e300, -5.0, -1e-12, 0.0, 1e-12, 3.0, 3.0, 1e300]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    r = O.exact_quantiles(df, [], "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}).first()
    assert (r.lo, r.hi, r.mid) == (-1e300, 1e300, 0.5e-12)


def test_hash_ordinal_is_dense_and_stable(hot):
    h = hot.withColumn("h", S.hash_bits(F.lit(7), "id"))
    a = {r.id: r.ordinal for r in O.with_hash_ordinal(h, "h", ["id"]).collect()}
    b = {r.id: r.ordinal for r in O.with_hash_ordinal(h.repartition(13), "h", ["id"], bits=4).collect()}
    assert a == b and sorted(a.values()) == list(range(3000))


def test_previous_value(hot):
    got = {r.id: r.before for r in O.with_previous(hot, ["g"], [F.col("id").asc()], "id", "before", hot_rows=50).collect()}
    for rows in groups(hot, "id").values():
        ids = sorted(r[0] for r in rows)
        assert [got[i] for i in ids] == [None, *ids[:-1]]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_partition_count_changes_nothing(spark, hot, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        r = O.exact_quantiles(hot, ["g"], "v", {"q": 0.37}).orderBy("g").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [round(x.q, 9) for x in r] == [round(x.q, 9) for x in O.exact_quantiles(hot.repartition(3), ["g"], "v", {"q": 0.37}).orderBy("g").collect()]


def test_nulls_and_nan(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 1.0), ("a", 3, None), ("a", 4, 5.0), ("a", 5, 5.0)], "g string, id bigint, v double")
    got = {r.id: (r["rank"], r.rank_n) for r in O.with_average_rank(df, ["g"], "v").collect()}
    assert got == {1: (2.0, 2), 2: (1.0, 2), 3: (None, None), 4: (1.5, 2), 5: (1.5, 2)}
    assert {r.g: r.q for r in O.exact_quantiles(df, ["g"], "v", {"q": 0.5}).collect()} == {None: 1.5, "a": 5.0}
    with pytest.raises(Exception, match="NaN in v"):
        O.exact_quantiles(df.unionByName(df.withColumn("v", F.lit(float("nan")))), ["g"], "v", {"q": 0.5}).collect()


def test_a_narrow_range_of_values_spreads_over_many_ranges(spark, monkeypatch):
    """10^5 distinct values within 1e-7, with NULL and hot groups: ranges stay near their size, sums are exact."""
    monkeypatch.setattr(O, "RANGE_ROWS", 2000)
    monkeypatch.setattr(O.range_cuts, "__defaults__", (2000,))
    df = spark.range(100_000).select(F.col("id"), (1 + F.col("id") * 1e-12).alias("v"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("hot")).alias("g"))
    cuts = O.range_cuts(df, "v")
    sizes = [r["count"] for r in df.groupBy(O.value_range("v", cuts).alias("b")).count().collect()]
    assert len(sizes) == 50 and max(sizes) < 2500
    got = O.running_totals(df, ["g"], "v", {"n": F.lit(1).cast("bigint"), "s": F.col("id")}).join(df.select("id", "v"), "v")
    pdf = got.toPandas().sort_values("id")
    for _, rows in pdf.groupby("g", dropna=False):
        assert (rows.n_below.to_numpy() == np.arange(len(rows))).all() and (rows.n_all == len(rows)).all()
        assert (rows.s_below.to_numpy() == np.cumsum(rows.id.to_numpy()) - rows.id.to_numpy()).all() and (rows.s_all == rows.id.sum()).all()


def test_ranges_agree_with_a_plain_search(spark):
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 15, 16, 17, 300):
        cuts = sorted(rng.normal(size=n).round(1).tolist())
        x = [float(v) for v in rng.normal(size=50).round(1)] + [float("inf"), float("-inf")]
        got = [r.b for r in spark.createDataFrame([(v,) for v in x], "v double").select(O.value_range("v", cuts).alias("b")).collect()]
        assert got == np.searchsorted(cuts, x, side="right").tolist()

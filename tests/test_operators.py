"""Edge cases of checks, selection, labels, evaluation, slices, audit and batching."""
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotworks.operators import audit as A
from slotworks.operators import batching as BT
from slotworks.operators import checks as C
from slotworks.operators import evaluate as E
from slotworks.operators import labels as L
from slotworks.operators import selection as SEL
from slotworks.operators import slices as SL


def rules(df):
    return {r.rule: r.n_violations for r in df.collect()}


# ---- selection ----------------------------------------------------------------

def series(spark, rows):
    return spark.createDataFrame(rows, "study_id string, series_id string, fat_sup int, plane string, n int, shard int")


def test_candidates_ties_and_depth(spark):
    df = series(spark, [("s", "b", 1, "Sagittal", 64, 0), ("s", "a", 1, "Sagittal", 64, 1), ("s", "c", 1, "Sagittal", 40, 2),
                        ("s", "d", 1, "Sagittal", 3, 3), ("s", "e", 1, "Sagittal", 2, 4)])
    slotted = SEL.usable_series(SEL.with_slot(df))
    ranked = SEL.rank_candidates(slotted).orderBy("rank").collect()
    assert [r.series_id for r in ranked] == ["a", "b", "c", "d"]
    hot = SEL.rank_candidates(slotted, hot_rows=1).orderBy("rank").collect()
    assert [r.series_id for r in hot] == ["a", "b", "c", "d"]
    legacy = SEL.rank_candidates(slotted.withColumn("o", F.when(F.col("series_id") == "b", 0).otherwise(1)), ordinal="o").orderBy("rank").collect()
    assert legacy[0].series_id == "b"
    assert SEL.select_series(slotted).first().series_id == "a"


def test_slot_order_and_unknown_values(spark):
    six = [("s", f"{f}{p}", f, p, 9, 0) for f in (1, 0) for p in ("Sagittal", "Coronal", "Axial")]
    df = SEL.with_slot(series(spark, six + [("s", "x", 2, "Axial", 9, 0), ("s", "y", 1, "Oblique", 9, 0), ("s", "z", None, "Axial", 9, 0)]))
    got = {r.series_id: r.slot for r in df.collect()}
    assert [got[f"{f}{p}"] for f in (1, 0) for p in ("Sagittal", "Coronal", "Axial")] == [0, 1, 2, 3, 4, 5]
    assert got["x"] is got["y"] is got["z"] is None and rules(SEL.expect_slots(df)) == {"unknown_plane_or_flag": 3}


def test_global_selection_before_the_shard_filter(spark):
    df = SEL.with_slot(series(spark, [("s1", "a", 1, "Sagittal", 30, 0), ("s1", "b", 1, "Sagittal", 35, 1), ("s2", "c", 1, "Axial", 20, 0)]))
    owned = SEL.ownership(SEL.select_series(df, ["n", "shard"]), [0])
    assert {(r.study_id, r.series_id, r.owned) for r in owned.collect()} == {("s1", "b", False), ("s2", "c", True)}


def test_plan_positions_and_digest(spark):
    sel = spark.createDataFrame([("1", 0, "9", 3, 2), ("1", 4, "8", 10, 5)], "study_id string, slot int, series_id string, n int, shard int")
    rows = SEL.plan_rows(sel).orderBy("slot", "k").collect()
    assert [r.position for r in rows if r.slot == 0] == [0.0, 0.5, 0.5, 1.0]
    text = "1:0:9:2:0,1,1,2\n1:4:8:5:0,3,6,9"
    assert A.plan_digest(SEL.plan_lines(sel), "sorted").first().digest == hashlib.sha256(text.encode()).hexdigest()


def test_missing_study_is_reported(spark):
    spine = spark.createDataFrame([("a",), ("b",)], "study_id string")
    sel = spark.createDataFrame([("a", 0)], "study_id string, slot int")
    assert rules(SEL.expect_every_study(spine, sel))["missing"] == 1


def test_sampled_candidate_is_uniform_and_stable(spark):
    df = spark.range(3000).select(F.floor(F.col("id") / 3).cast("string").alias("study_id"), F.lit(0).alias("slot"), (F.col("id") % 3).cast("string").alias("series_id"), F.lit(9).alias("n"))
    a = {r.study_id: r.series_id for r in SEL.sample_candidate(df, 1, 0).collect()}
    b = {r.study_id: r.series_id for r in SEL.sample_candidate(df.repartition(7), 1, 0).collect()}
    c = {r.study_id: r.series_id for r in SEL.sample_candidate(df, 1, 1).collect()}
    assert a == b and a != c and len(a) == 1000
    assert all(250 < list(a.values()).count(s) < 420 for s in "012")


def test_union_of_wrong_shards_is_refused(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        SEL.union_shards({0: df}, {0, 1})


# ---- checks ---------------------------------------------------------------------

def test_require_clean(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 2.0)], "id string, p double")
    with pytest.raises(ValueError, match="p:range"):
        C.require_clean(C.expect_probability(df, "id", ["p"]))
    C.require_clean(C.expect_probability(df.filter("p < 1"), "id", ["p"]))


def test_empty_table_has_no_violations(spark):
    df = spark.createDataFrame([], "id string, p double")
    assert set(rules(C.expect_probability(df, "id", ["p"])).values()) == {0}
    assert set(rules(C.expect_ids(df, "id")).values()) == {0}


def test_roles_of_an_empty_holdout(spark):
    df = spark.createDataFrame([("a", False, 1), ("b", True, -1), ("c", False, 7)], "study_id string, is_gold boolean, fold int")
    got = rules(C.expect_roles(C.split_roles(df, 0), "study_id"))
    assert got == {"two_roles": 0, "invalid_fold": 1, "empty_holdout": 1}


def test_config_diff(spark):
    runs = spark.createDataFrame([("a", {"h": "x", "s": "1"}), ("b", {"h": "y", "s": "1"}), ("c", {"h": "y", "s": "2"}), ("d", {"h": "y"})], "run_id string, config map<string,string>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d")], "left_run string, right_run string")
    got = {r.right_run: (r.same_keys, r.changed, r.allowed) for r in C.config_diff(runs, pairs, ["h"]).collect()}
    assert got == {"b": (True, "h", True), "c": (True, "h,s", False), "d": (False, "h", False)}


# ---- labels -----------------------------------------------------------------------

def test_consensus_silence_weights_and_clip(spark):
    rows = [("a", "1", "l", 0.0), ("b", "1", "l", None), ("a", "2", "l", 1.0), ("b", "2", "l", 0.4), ("a", "3", "l", None), ("b", "3", "l", float("nan"))]
    df = spark.createDataFrame(rows, "source string, study_id string, label string, p double")
    got = {r.study_id: r.p for r in L.consensus(df, {"b": 2.0}).collect()}
    assert got["1"] == 0.01 and got["2"] == pytest.approx(0.6) and got["3"] is None
    assert {r.study_id: r.p for r in L.consensus(df, {"a": 0.0}).collect()} == {"1": None, "2": 0.4, "3": None}


def greedy(sizes, k):
    load, out = [0] * k, []
    for s in sorted(sizes, reverse=True):
        f = min(range(k), key=lambda i: (load[i], i))
        load[f] += s
        out.append((s, f))
    return load, out


def test_fold_schedule_equals_greedy():
    rng = np.random.default_rng(3)
    for _ in range(300):
        k = int(rng.integers(2, 7))
        hist = {int(s): int(rng.integers(1, 40)) for s in rng.choice(60, int(rng.integers(1, 9)), replace=False) + 1}
        want = greedy([s for s, c in hist.items() for _ in range(c)], k)[1]
        got = []
        for size, first, last, cycle in L.fold_schedule(list(hist.items()), k):
            got += [(size, cycle[(o - first) % len(cycle)]) for o in range(first, last)]
        assert got == want


def test_group_folds_keep_groups_together(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 1700, F.lit("hot")).otherwise((F.col("id") % 900).cast("string")).alias("g"))
    a = L.group_folds(df, "g")
    assert a.count() == 5000 and a.groupBy("g").agg(F.countDistinct("fold").alias("c")).filter("c > 1").count() == 0
    sizes = sorted(r.n for r in L.fold_sizes(a).collect())
    assert sizes[-1] == 1700 and sizes[3] - sizes[0] <= 5
    b = L.group_folds(df.repartition(9), "g", hash_bits=3)
    assert {(r.id, r.fold) for r in a.collect()} == {(r.id, r.fold) for r in b.collect()}


def test_components_match_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(500 + i, 501 + i) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in L.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in {v for e in edges if e[0] != e[1] for v in e}}


def test_templates_match_all_pairs_over_bands(spark):
    base = "the knee shows no tear of the anterior ligament and a small effusion without further findings today"
    texts = [base, base + " again", base.upper(), "a fully different report about nothing of the kind at all here", "", "x", "x", base.replace("small", "large")]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    bands = {}
    for r in L.template_bands(L.template_signatures(df, "id", "text"), "id").collect():
        bands.setdefault((r.band, r.signature), set()).add(r.id)
    label = list(range(len(texts)))
    for _ in texts:
        for members in bands.values():
            low = min(label[m] for m in members)
            for m in members:
                label[m] = low
    got = {r.id: r.template for r in L.near_template_groups(df, "id", "text").collect()}
    assert got == dict(enumerate(label)) and got[2] == 0 and got[6] == 5 and got[3] == 3


def test_near_templates_match_brute_force(spark):
    """Chains and mixed buckets: a pair at the threshold is linked whatever the smallest key of its bucket is."""
    rng, texts = random.Random(4), []
    for _ in range(30):
        base = [f"w{rng.randrange(400)}" for _ in range(60)]
        for _ in range(8):
            own, n = list(base), rng.choice([0, 2, 4, 5, 6])
            for at in rng.sample(range(60), n):
                own[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    sets = [{tuple(t.split()[i:i + 3]) for i in range(58)} for t in texts]
    label, change = list(range(len(texts))), True
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])]
    while change:
        change = False
        for i, j in pairs:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                change = True
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    assert {r.id: r.template for r in L.near_template_groups(df, "id", "text").collect()} == dict(enumerate(label))


def test_blocks_link_members_that_no_head_matches(spark, monkeypatch):
    """Members that share a bucket with a smallest node which neither of them matches keep their link."""
    monkeypatch.setattr(L, "BLOCK", 2)
    base = [f"w{i}" for i in range(80)]
    half = base[:40] + [f"y{i}" for i in range(40)]
    texts = [" ".join(base), " ".join(half), " ".join(half[:-1] + ["z"]), " ".join(half[:-2] + ["u", "v"]), "quite another text of its own"]
    signed = L.template_signatures(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), "id", "text").collect()
    node = {r.node: r.id for r in signed}
    code = {r.id: r.packed for r in signed}
    shape = "signature bigint, node string, component string, packed array<bigint>"
    # one bucket of five members, each a component of its own
    members = spark.createDataFrame([(1, n, n, code[i]) for n, i in node.items()], shape)
    open_ = L._block_partners(L._mixed_blocks(members), 144, 0.37)
    sets = L.template_shingles(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), "id", "text")
    named = spark.createDataFrame([(i, n) for n, i in node.items()], "id bigint, node string")
    links = L._block_links(open_.join(sets.join(named, "id").drop("id"), "node"), 144, 0.37, 0.6).collect()
    found = {frozenset((node[r.a], node[r.b])) for r in links}
    assert found <= {frozenset(p) for p in ((1, 2), (1, 3), (2, 3))} and len(found) >= 2


def test_members_are_dealt_without_their_minima(spark):
    """Minima join the members of mixed buckets only; a bucket of one component is left out."""
    members = spark.createDataFrame([(1, b"a", b"a"), (1, b"b", b"b"), (1, b"c", b"a"), (2, b"a", b"a"), (2, b"c", b"a")], "signature bigint, node binary, component binary")
    blocks = L._mixed_blocks(members)
    assert blocks.columns == ["signature", "i", "j", "node", "component"]
    assert {(r.signature, bytes(r.node), bytes(r.component)) for r in blocks.collect()} == {(1, b"a", b"a"), (1, b"b", b"b"), (1, b"c", b"a")}


# ---- evaluation ---------------------------------------------------------------------

def brute_auc(y, s, w=None):
    w = np.ones(len(y)) if w is None else np.asarray(w, float)
    y, s = np.asarray(y), np.asarray(s)
    p, n = y == 1, y == 0
    den = w[p].sum() * w[n].sum()
    win = (s[p][:, None] > s[n]) + 0.5 * (s[p][:, None] == s[n])
    return None if den == 0 else float((w[p][:, None] * w[n] * win).sum() / den)


def predictions(spark, n=58, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i, m, l in itertools.product(range(n), ("r", "c"), range(3)):
        y = int(i == 5) if l == 0 else i % 2
        rows.append((m, f"{i:03d}", f"l{l}", float(np.round(rng.normal() + y, 0)), y))
    return spark.createDataFrame(rows, "model string, study_id string, label string, score double, y int"), rows


def test_auc_ties_single_class_and_extremes(spark):
    df, rows = predictions(spark)
    got = {(r.model, r.label): r.auc for r in E.auc(df, ["model", "label"]).collect()}
    for m, l in got:
        part = [(r[4], r[3]) for r in rows if r[0] == m and r[2] == l]
        assert got[m, l] == pytest.approx(brute_auc(*zip(*part)), abs=1e-12)
    one = df.withColumn("y", F.lit(1))
    assert {r.auc for r in E.auc(one, ["model"]).collect()} == {None}
    big = spark.createDataFrame([(i % 2, 900.0 + 200 * (i % 2) + i) for i in range(58)], "y int, score double").withColumn("g", F.lit(0))
    assert E.auc(big, ["g"]).first().auc == 1.0


def test_macro_policies(spark):
    per = spark.createDataFrame([("m", "a", 0.5), ("m", "b", None)], "model string, label string, auc double")
    assert E.macro_auc(per, ["model"]).first().macro_auc == 0.5
    assert E.macro_auc(per, ["model"], "require_all").first().macro_auc is None


@pytest.mark.parametrize("method", ["resample", "poisson"])
def test_bootstrap_equals_brute_force(spark, method):
    df, rows = predictions(spark)
    draw = E.bootstrap_draws if method == "resample" else E.poisson_draws
    weights = {}
    for r in draw(df.select("study_id"), "study_id", 25, 7).collect():
        weights.setdefault(r.rep, {})[r.study_id] = r.w
    if method == "resample":
        assert all(sum(w.values()) == 58 for w in weights.values())
    undefined = 0
    for r in E.bootstrap_auc(df, 25, 7, method).collect():
        part = [(x[4], x[3], weights[r.rep].get(x[1], 0)) for x in rows if x[0] == r.model and x[2] == r.label]
        want = brute_auc(*zip(*part))
        assert (r.auc is None and want is None) or r.auc == pytest.approx(want, abs=1e-12)
        undefined += want is None
    assert undefined > 0


def test_bootstrap_over_many_ranges_with_a_hot_score(spark):
    """A score that a third of the rows share fills ranges of its own; sums over ranges equal those of one range."""
    rng = np.random.default_rng(3)
    rows = [("m", f"s{i}", "l", 0.5 if i % 3 == 0 else float(np.round(rng.random(), 3)), i % 4 == 0) for i in range(6000)]
    df = spark.createDataFrame([(m, s, l, x, int(y)) for m, s, l, x, y in rows], "model string, study_id string, label string, score double, y int")
    one, many = ({r.rep: r.auc for r in E.bootstrap_auc(df, 4, 7, cells=c).collect()} for c in (4_000_000, 4000))
    assert one.keys() == many.keys() == {0, 1, 2, 3} and all(many[r] == pytest.approx(one[r], abs=1e-12) for r in one)


def test_intervals_and_paired_delta(spark):
    df, _ = predictions(spark)
    boot = E.bootstrap_auc(df, 25, 7)
    delta = E.paired_delta(boot, "r").collect()
    raw = {(r.rep, r.model, r.label): r.auc for r in boot.collect()}
    for r in delta:
        if r.label != "MACRO":
            a, b = raw[r.rep, r.model, r.label], raw[r.rep, "r", r.label]
            assert r.delta == (None if a is None else pytest.approx(a - b))
        else:
            parts = [(raw[r.rep, r.model, f"l{i}"], raw[r.rep, "r", f"l{i}"]) for i in range(3)]
            assert (r.delta is None) if any(p[0] is None for p in parts) else r.delta == pytest.approx(np.mean([a - b for a, b in parts]))
    ci = {(r.model, r.label): r for r in E.percentile_ci(E.with_macro(boot), ["model", "label"], "auc").collect()}
    v = np.array([raw[i, "c", "l0"] for i in range(25) if raw[i, "c", "l0"] is not None])
    r = ci["c", "l0"]
    assert (r.defined, r.dropped) == (len(v), 25 - len(v)) and np.allclose([r.low, r.high], np.quantile(v, [.025, .975]))


def test_spearman_and_overlap(spark):
    rows = [("l", f"{i}", i % 2, i / 10, (9 - i) / 10, 0.5) for i in range(10)]
    df = spark.createDataFrame(rows, "label string, study_id string, y int, a double, b double, c double")
    assert E.spearman(df, ["label"], "a", "b").first().spearman == pytest.approx(-1)
    assert E.spearman(df, ["label"], "a", "c").first().spearman is None
    perfect = df.withColumn("a", F.col("y").cast("double")).withColumn("b", F.col("y").cast("double"))
    assert {r.jaccard for r in E.error_overlap(perfect, "a", "b").collect()} == {None}


def test_rank_blend_order(spark):
    rows = [(m, f"{i}", "l", s) for m, v in (("S", [.1, .2, .2, .9]), ("C", [.9, .1, .5, .4])) for i, s in enumerate(v)]
    df = spark.createDataFrame(rows, "model string, study_id string, label string, score double")
    got = {r.study_id: r.blend for r in E.rank_blend(df, {"S": 0.7, "C": 0.3}).collect()}
    s, c = np.array([1, 2.5, 2.5, 4]) / 4, np.array([4, 1, 3, 2]) / 4
    mix = np.round(.7 * s + .3 * c, 12)
    assert [got[f"{i}"] for i in range(4)] == [((mix < x).sum() + ((mix == x).sum() + 1) / 2) / 4 for x in mix]


# ---- slices, audit, batching ------------------------------------------------------------

def test_slice_order_rules(spark):
    o = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    rows = [("sp", i, 0, float(i), None if i == 0 else o, [0.0, 0.0, float(z)], None) for i, z in enumerate([5, 9, 1, 5])]
    rows += [("no", i, i % 2, float(9 - i // 2), o, None, None) for i in range(4)]
    rows += [("pl", 0, 0, 1.0, None, None, "Coronal"), ("one", 0, 0, 1.0, o, [0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "series_id string, ordinal int, frame int, instance double, orientation array<double>, ipp array<double>, plane_name string")
    ordered = SL.order_slices(df)
    got = {}
    for r in ordered.orderBy("series_id", "slice_no").collect():
        got.setdefault(r.series_id, []).append(r.ordinal)
    assert got["sp"] == [1, 0, 3, 2] and got["no"] == [2, 3, 0, 1]
    assert {r.series_id: r.plane for r in ordered.filter("series_id IN ('pl', 'sp')").select("series_id", "plane").distinct().collect()} == {"pl": 1, "sp": 2}
    gaps = {r.series_id: r.slice_gap for r in SL.gap_median(ordered).collect()}
    assert gaps == {"sp": 4.0, "one": 0.0}


def test_intensity_of_a_flat_series(spark):
    px = spark.range(64).select(F.lit("s").alias("series_id"), (F.col("id") % 8).alias("row"), F.floor(F.col("id") / 8).alias("col"), F.lit(7.0).alias("value"))
    assert {r.level for r in SL.intensity_window(px).collect()} == {0}


def test_digests(spark):
    df = spark.createDataFrame([("b", 2, "y"), ("a", 1, "x"), ("a10", 3, "z")], "id string, n int, sha string")
    assert A.ids_digest(df, "id", "sorted").first().digest == hashlib.sha256(b"a\na10\nb").hexdigest()
    assert A.table_digest(df, "id", "n", "sha", "sorted").first().digest == hashlib.sha256(b"a\t1\tx\na10\t3\tz\nb\t2\ty\n").hexdigest()
    two = A.ids_digest(df.repartition(3), "id").first()
    assert (two.scheme, two.n) == ("tree2", 3) and two.digest == A.ids_digest(df, "id").first().digest
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    mid = {}
    for p, d in sorted((sha(i)[:6], sha(i)) for i in ("a", "b", "a10")):
        mid.setdefault(p[:3], []).append(f"{p}\t{d}")
    nodes = sorted(p + "\t" + sha("\n".join(sorted(v))) for p, v in mid.items())
    assert two.digest == sha("\n".join(nodes))
    twice = A.lines_digest(df.unionByName(df), "id", ["id"]).first()
    assert twice.n == 6 and twice.digest != two.digest
    assert A.ids_digest(df.limit(0), "id", "sorted").first().digest == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        A.ids_digest(df, "id", scheme="auto")


def test_digest_scheme_does_not_depend_on_size(spark):
    for n in (10, 2_000_000):
        ids = spark.range(n)
        assert A.ids_digest(ids, "id").first().scheme == "tree2"
        assert A.ids_digest(ids, "id", "sorted").first().digest == hashlib.sha256("\n".join(sorted(map(str, range(n)))).encode()).hexdigest()


def test_config_identity(spark):
    conf = spark.createDataFrame([({"b": "1", "a": "2"},)], "c map<string,string>")
    assert A.config_identity(conf, "c").first().identity == hashlib.sha256(b'{"a":"2","b":"1"}').hexdigest()


def test_caps_and_forecast(spark):
    images = [12240, 12528, 12580, 12332, 12364, 12496, 10796]
    df = spark.createDataFrame(list(enumerate(images)), "shard int, images int")
    caps = [r.cap_seconds for r in A.allocate_caps(df, 9000 - 600 - 420, 60).orderBy("shard").collect()]
    assert caps == [7980 * i // sum(images) + 60 for i in images] and sum(caps) + 600 <= 9000
    shards = df.withColumn("bytes", F.lit(1)).withColumn("cap_seconds", F.lit(100000))
    rate = lambda r: spark.createDataFrame([(float(r), 1e12, 30.0)], "images_per_second double, bytes_per_second double, startup_seconds double")
    total = lambda r: A.route_forecast(shards, rate(r), 600, 9000).filter("shard = -1").first().fits
    assert total(5) is False and total(25) is True


def test_batches_drop_the_tail_and_resume(spark):
    ids = spark.range(45).select(F.col("id").cast("string").alias("id"))
    rows = BT.epoch_batches(ids, "id", 1, 0, 2, 4).orderBy("ordinal").collect()
    assert len(rows) == 40 and len({r.id for r in rows}) == 40 and rows[-1].group == 4 and rows[-1].batch == 19
    again = BT.epoch_batches(ids.repartition(5), "id", 1, 0, 2, 4, start_group=3).orderBy("ordinal").collect()
    assert [r.id for r in again] == [r.id for r in rows[24:]]


def test_rolling_median_across_chunks(spark):
    v = np.random.default_rng(0).uniform(1, 100, 200)
    df = spark.createDataFrame([("r", i, float(x)) for i, x in enumerate(v)], "run string, step int, sec double")
    got = [r.median for r in BT.rolling_median(df, "run", "step", "sec", chunk=9, hot_rows=20).orderBy("step").collect()]
    assert np.allclose(got, [np.median(v[max(0, i - 7):i + 1]) for i in range(200)])


def test_gates_before_metrics_and_blends(spark):
    pairs = spark.createDataFrame([(1.0, 3.0), (2.0, 1.0), (3.0, 2.0), (9.0, None), (None, 0.0)], "a double, b double")
    assert E.spearman(pairs, [], "a", "b").first().spearman == pytest.approx(-0.5)
    preds = spark.createDataFrame([("s", "l", "m", 0.2), ("t", "l", "m", 0.4), ("s", "l", "n", 0.9)], "study_id string, label string, model string, score double")
    with pytest.raises(Exception, match="lacks"):
        E.rank_blend(preds, {"m": 0.5, "n": 0.5}).collect()
    with pytest.raises(Exception, match="lacks"):
        E.fixed_blend(preds.filter("model = 'm'").withColumnRenamed("score", "prob"), preds.filter("model = 'n'").withColumnRenamed("score", "prob")).collect()
    with pytest.raises(Exception, match="members"):
        E.ensemble_mean(preds.withColumnRenamed("score", "prob"), members=2).collect()
    wide = spark.createDataFrame([("s", "l", 1, 0.2, None)], "study_id string, label string, y int, a double, b double")
    with pytest.raises(Exception, match="missing value in b"):
        E.error_overlap(wide, "a", "b").collect()


def test_folds_keep_the_null_group(spark):
    from slotworks.operators.labels import group_folds
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4)], "g string, id int")
    got = {r.id: r.fold for r in group_folds(df, "g", 2).collect()}
    assert len(got) == 4 and got[1] == got[2]


def test_pieces_of_spread_do_not_grow(spark):
    """Four times the bytes of a piece per core give four times as many pieces, not larger ones."""
    from slotworks.session import PIECE_BYTES, spread
    cores = spark.sparkContext.defaultParallelism
    df = spread(spark.range(4 * cores * PIECE_BYTES // 8), "id")
    assert "hashpartitioning(id#" in (plan := df._jdf.queryExecution().executedPlan().toString()) and f", {4 * cores})" in plan.replace("L,", ",")
    assert f", {cores})" in spread(spark.range(100), "id")._jdf.queryExecution().executedPlan().toString().replace("L,", ",")

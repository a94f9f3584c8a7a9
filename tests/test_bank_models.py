"""Banks, merge, resume, models, sources, sinks and streams."""
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotworks.operators import bank as B
from slotworks.operators import checks as C
from slotworks.operators import models as M
from slotworks.sources import banks, sinks, tables
from slotworks.streaming import incremental as I

D = 5


def make_bank(spark, studies=12, slots=3, k=4, seed=0):
    rng = np.random.default_rng(seed)
    rows, dense = [], np.zeros((studies, slots, k, D))
    mask = np.zeros((studies, slots), bool)
    for s in range(studies):
        for slot in range(slots):
            if (s + slot) % 4 == 0 and slot:
                continue
            mask[s, slot] = True
            for i in range(k):
                v = rng.normal(size=D).astype(np.float16).astype(np.float64)
                dense[s, slot, i] = v
                rows.append((f"{s:03d}", slot, i, float(np.float32(i / (k - 1))), f"{s}-{slot}", (s + slot) % 7, "id1", v.tolist()))
    return spark.createDataFrame(rows, banks.BANK), dense, mask


def test_pooling_matches_numpy_and_ignores_absent_slots(spark):
    bank, dense, mask = make_bank(spark)
    for r in B.meanmax_pool(bank).collect():
        v = dense[int(r.study_id)][mask[int(r.study_id)]].reshape(-1, D)
        assert np.allclose(r["mean"], v.mean(0)) and np.allclose(r["max"], v.max(0))
    scored = bank.withColumn("c", F.col("embedding")[0].cast("double") * 500)
    spine = bank.select("study_id").union(spark.createDataFrame([("empty",)], "study_id string"))
    got = {r.study_id: r.pooled for r in B.attention_pool(scored, ["c"], spine, D).collect()}
    assert got.pop("empty") == [0.0] * D and len(got) == 12
    for s, pooled in got.items():
        v = dense[int(s)][mask[int(s)]].reshape(-1, D)
        w = np.exp(v[:, 0] * 500 - (v[:, 0] * 500).max())
        assert np.allclose(pooled, (w[:, None] * v).sum(0) / w.sum())


def test_slot_stats_use_fit_ids_and_floor(spark):
    rows = [("a", 0, [1.0, 3.0]), ("b", 0, [3.0, 7.0]), ("c", 0, [900.0, 900.0]), ("a", 1, [4.0, 4.0])]
    pooled = spark.createDataFrame(rows, "study_id string, slot int, pooled array<double>")
    fit = spark.createDataFrame([("a",), ("b",)], "study_id string")
    twelve = lambda v: [round(x, 12) for x in v]
    got = {r.slot: (r.n, twelve(r["mean"]), twelve(r["std"])) for r in B.slot_stats(pooled, fit, 2, slots=3).collect()}
    assert got == {0: (2, [2.0, 5.0], [1.0, 2.0]), 1: (1, [4.0, 4.0], [0.001, 0.001]), 2: (0, [0.0, 0.0], [0.001, 0.001])}


def test_ridge_equals_closed_form(spark):
    bank, dense, mask = make_bank(spark, 40)
    pooled = B.slot_mean_pool(bank)
    fit = bank.select("study_id").distinct().filter("study_id < '030'")
    design = M.slot_design(pooled, B.slot_stats(pooled, fit, D, 3), D, 3)
    soft = spark.createDataFrame([(f"{s:03d}", l, (s * (j + 3) % 11) / 10) for s in range(40) for j, l in enumerate(["x", "y"])], "study_id string, label string, p double")
    model = M.ridge_fit(design.join(fit, "study_id", "left_semi"), M.target_logits(soft, ["x", "y"]), ["x", "y"], 3 * D + 3, alpha=10.0)

    mean = dense.mean(2)
    X = np.zeros((40, 3 * D + 3))
    for slot in range(3):
        seen = mask[:30, slot]
        mu, sd = mean[:30][seen, slot].mean(0), np.maximum(mean[:30][seen, slot].std(0), .001)
        X[:, slot * D:(slot + 1) * D] = np.where(mask[:, slot:slot + 1], (mean[:, slot] - mu) / sd, 0)
        X[:, 3 * D + slot] = mask[:, slot]
    p = np.clip(np.array([[(s * (j + 3) % 11) / 10 for j in range(2)] for s in range(40)]), 1e-4, 1 - 1e-4)
    Y = np.log(p) - np.log1p(-p)
    xc, yc = X[:30] - X[:30].mean(0), Y[:30] - Y[:30].mean(0)
    assert np.abs(xc.T @ (yc - xc @ model.coef.T) - 10.0 * model.coef.T).max() < 1e-8  # gradient of the objective
    again = M.ridge_fit(design.join(fit, "study_id", "left_semi"), M.target_logits(soft, ["x", "y"]), ["x", "y"], 3 * D + 3, alpha=10.0, method="cg")
    assert np.allclose(again.coef, model.coef, atol=1e-8) and np.allclose(again.intercept, model.intercept, atol=1e-8)
    want = X @ model.coef.T + Y[:30].mean(0) - X[:30].mean(0) @ model.coef.T
    for r in model.predict(design).collect():
        z = want[int(r.study_id), ["x", "y"].index(r.label)]
        assert r.logit == pytest.approx(z, abs=1e-9) and r.prob == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_ridge_refuses_missing_targets_and_leaks(spark):
    bank, _, _ = make_bank(spark)
    pooled = B.slot_mean_pool(bank)
    soft = spark.createDataFrame([(f"{s:03d}", "x", None if s == 3 else 0.5) for s in range(12)], "study_id string, label string, p double")
    design = M.slot_design(pooled, B.slot_stats(pooled, bank, D, 3), D, 3)
    with pytest.raises(Exception, match="non-finite"):
        M.ridge_fit(design, M.target_logits(soft, ["x"]), ["x"], 3 * D + 3)
    with pytest.raises(ValueError, match="leak"):
        ids = bank.select("study_id").distinct()
        C.require_clean(C.expect_disjoint(ids, ids, ["study_id"], "leak"))


def test_soft_logistic_beats_the_constant(spark):
    bank, dense, mask = make_bank(spark, 60)
    feats = B.meanmax_pool(bank).select("study_id", "pooled")
    soft = feats.select("study_id", F.lit("x").alias("label"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("pooled")[0] * 4))).alias("p"))
    out = M.soft_logistic_predict(M.soft_logistic_fit(feats, soft, ["x"], iterations=20), feats).join(soft, ["study_id", "label"])
    from slotworks.operators.evaluate import soft_bce
    r = soft_bce(out, ["label"]).first()
    assert r.target_entropy <= r.bce < r.prevalence_bce


def test_spectrum_of_a_line(spark):
    rows = [(f"{i}", 0, 0, 0.0, "a", 0, "id1", [float(i), 2.0 * i, 0.0]) for i in range(20)]
    r = M.covariance_spectrum(spark.createDataFrame(rows, banks.BANK), 3).filter("scope = 'all'").first()
    assert r.top1 == pytest.approx(1) and r.effective_rank == pytest.approx(1, abs=1e-6)


def test_attention_score_matches_numpy(spark):
    from slotworks.plans.bank_queries import head_weights
    import math
    bank, dense, mask = make_bank(spark)
    W = head_weights(D, slots=3)
    erf = np.vectorize(math.erf)
    gelu = lambda x: 0.5 * x * (1 + erf(x / np.sqrt(2)))
    got = {(r.study_id, r["class"]): r.logit for r in M.attention_score(bank, W, ["c0", "c1"]).collect()}
    for s in range(12):
        hs, ss = [], []
        for slot in np.flatnonzero(mask[s]):
            for k in range(4):
                x = dense[s, slot, k]
                x = (x - x.mean()) / np.sqrt(x.var() + 1e-5)
                h = gelu(W["proj_w"] @ x + W["proj_b"]) + W["slot"][slot]
                p = np.array([np.float64(np.float32(k / 3))])
                h = h + W["pos2_w"] @ gelu(W["pos1_w"] @ p + W["pos1_b"]) + W["pos2_b"]
                hs.append(h)
                ss.append(W["att2_w"] @ np.tanh(W["att1_w"] @ h + W["att1_b"]) + W["att2_b"])
        hs, ss = np.array(hs), np.array(ss)
        for c in range(2):
            w = np.exp(ss[:, c] - ss[:, c].max())
            want = (w[:, None] * hs).sum(0) / w.sum() @ W["class_w"][c] + W["class_b"][c]
            assert got[f"{s:03d}", f"c{c}"] == pytest.approx(want, abs=1e-9)


def test_embed_refuses_bad_output(spark):
    df = spark.createDataFrame([(i, [float(i)] * 4) for i in range(10)], "id int, pixels array<float>")
    good = M.batch_embed(df, lambda: lambda x: x[:, :2], [4], 2, batch_size=3).collect()
    assert {r.id: r.embedding for r in good} == {i: [float(i)] * 2 for i in range(10)}
    with pytest.raises(Exception, match="another shape"):
        M.batch_embed(df, lambda: lambda x: x, [4], 2).collect()


# ---- merge and resume ----------------------------------------------------------------

@pytest.mark.parametrize("break_it, rule", [
    (lambda b: b.unionByName(b.filter("study_id = '001' AND slot = 0")), "overlap"),
    (lambda b: b.filter("shard != 3"), "missing"),
    (lambda b: b.withColumn("position", F.when(F.col("k") == 1, F.lit(0.9)).otherwise(F.col("position")).cast("float")), "wrong_position"),
    (lambda b: b.withColumn("series_id", F.lit("other")), "wrong_series"),
    (lambda b: b.withColumn("shard", F.lit(6)), "wrong_shard"),
    (lambda b: b.withColumn("identity", F.lit("id2")), "other_identity"),
    (lambda b: b.unionByName(b.filter("k = 0").withColumn("k", F.lit(9))), "unexpected")])
def test_merge_rejects(spark, break_it, rule):
    bank, _, _ = make_bank(spark)
    with pytest.raises(ValueError, match=rule):
        B.merge_partials(bank, break_it(bank), "id1")


def test_merge_and_geometry_accept_a_whole_bank(spark):
    bank, _, _ = make_bank(spark)
    assert B.merge_partials(bank, bank, "id1").count() == bank.count()
    C.require_clean(C.bank_geometry(bank, width=D, k=4, slots=3))


def test_pending(spark):
    plan = spark.createDataFrame([("a",), ("b",), ("c",)], "study_id string")
    done = spark.createDataFrame([("a", "id1"), ("b", "id0")], "study_id string, identity string")
    assert {r.study_id for r in B.pending_ids(plan, done, "id1").collect()} == {"b", "c"}
    with pytest.raises(ValueError):
        C.require_clean(B.expect_same_identity(done, "id1"))


# ---- sources and sinks ----------------------------------------------------------------

def test_csv_readers_keep_ids_and_reports(spark, folder):
    with open(f"{folder}/train.csv", "w") as f:
        f.write('StudyInstanceUID,Report,ACL\n1.20,"two\nlines, ""quoted""",1\n1.2,x,\n')
    rows = tables.read_studies(spark, f"{folder}/train.csv", ["ACL"], columns=["StudyInstanceUID", "Report", "ACL"]).orderBy("study_id").collect()
    assert [(r.study_id, r.ACL) for r in rows] == [("1.2", None), ("1.20", 1.0)] and rows[1].report == 'two\nlines, "quoted"'
    with open(f"{folder}/series.csv", "w") as f:
        f.write("StudyInstanceUID,SeriesInstanceUID,Fat_Suppression,Anatomical_Plane\n1.2,9.10,1,Axial\n")
    assert tuple(tables.read_series(spark, f"{folder}/series.csv", schema=tables.SERIES).first()) == ("1.2", "9.10", 1, "Axial")
    with pytest.raises(ValueError):
        tables.read_series(spark, f"{folder}/train.csv")


def test_manifest_forms(spark, folder):
    member = "path string, bytes bigint"
    for name, text in (("a.json", '[{"path":"x","bytes":1},{"path":"y","bytes":2}]'), ("d.json", '{"members":[{"path":"x","bytes":1},\n{"path":"y","bytes":2}]}'), ("l.json", '{"path":"x","bytes":1}\n{"path":"y","bytes":2}\n')):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    for args in (dict(path=f"{folder}/a.json"), dict(path=f"{folder}/d.json", array_field="members"), dict(path=f"{folder}/l.json", lines=True)):
        assert {tuple(r) for r in tables.read_manifest(spark, member=member, **args).collect()} == {("x", 1), ("y", 2)}


def test_npz_round_trip_and_refusals(spark, folder):
    bank, _, _ = make_bank(spark)
    files = spark.createDataFrame([tuple(r) for r in banks.export_npz_bank(bank, folder, 3, 4).collect()], "path string, study_id string, shard int, bytes bigint")
    back = banks.import_npz_bank(files, "id1", 3, 4, D)
    key = lambda df: {(r.study_id, r.slot, r.k, r.series_id, r.position, tuple(r.embedding)) for r in df.collect()}
    assert key(back) == key(bank)
    with pytest.raises(Exception, match="other study or identity"):
        banks.import_npz_bank(files, "id2", 3, 4, D).count()
    with pytest.raises(Exception, match="malformed geometry"):
        banks.import_npz_bank(files, "id1", 3, 4, D + 1).count()


def test_slices_from_archives(spark, folder):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for a in range(2):
        with zipfile.ZipFile(f"{folder}/{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for i in range(6):
                v = rng.integers(0, 256, (3 + i, 4, 4), dtype=np.uint8)
                with z.open(f"m/{i}.npy", "w") as f:
                    np.save(f, v)
                rows.append((f"{a}-{i}", f"{folder}/{a}.zip", f"m/{i}.npy", 3 + i))
                want.update({(f"{a}-{i}", s): v[s].ravel().tolist() for s in range(len(v))})
    loc = "series_id string, archive string, member string, n int"
    got = banks.read_slices(spark.createDataFrame(rows, loc), 4, members_per_task=3)
    assert {(r.series_id, r.slice_no): r.pixels for r in got.collect()} == want
    wrong = [(s, a, m, n + (s == "0-0")) for s, a, m, n in rows]
    with pytest.raises(Exception, match="geometry differs"):
        banks.read_slices(spark.createDataFrame(wrong, loc), 4).count()
    with open(f"{folder}/t.npy", "wb") as f:
        np.save(f, np.zeros((3, 4, 4), np.uint8))
        f.write(b"x")
    with pytest.raises(Exception, match="trailing bytes"):
        banks.read_slices(spark.createDataFrame([("t", None, f"{folder}/t.npy", 3)], loc), 4).count()


def test_publish_is_refused_or_leaves_nothing(spark, folder):
    rows, receipt = spark.range(5), spark.createDataFrame([("ok",)], "kind string")
    broken = rows.withColumn("x", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        sinks.publish_once(broken, f"{folder}/out", receipt)
    assert not os.path.exists(f"{folder}/out") and not os.path.exists(f"{folder}/out__staging")
    sinks.publish_once(rows, f"{folder}/out", receipt)
    assert spark.read.parquet(f"{folder}/out/data").count() == 5
    with pytest.raises(FileExistsError):
        sinks.publish_once(rows, f"{folder}/out", receipt)


def test_predictions_in_label_order(spark, folder):
    df = spark.createDataFrame([(i, l, p) for i in ("b", "a") for l, p in (("y", .2), ("x", .1))], "study_id string, label string, prob double")
    sinks.write_predictions(df, f"{folder}/p", ["x", "y"])
    text = "".join(open(f"{folder}/p/{f}").read() for f in sorted(os.listdir(f"{folder}/p")) if f.endswith(".csv"))
    assert [t for t in text.split() if not t.startswith("study_id")] == ["a,0.1,0.2", "b,0.1,0.2"] and text.startswith("study_id,x,y")


def test_schema_contract(spark):
    df = spark.createDataFrame([(1, "a")], "b int, a string")
    spec = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType())])
    got = {r.rule: r.n_violations for r in C.schema_contract(df, spec).collect()}
    assert got == {"duplicate_columns": 0, "missing_columns": 0, "unexpected_columns": 0, "column_order": 1, "column_types": 1}
    twice = df.select("a", F.col("a"))
    assert {r.rule: r.n_violations for r in C.schema_contract(twice, spec).collect()}["duplicate_columns"] == 1


# ---- streams ------------------------------------------------------------------------------

def test_incremental_extract_resumes_and_replays(spark, folder):
    schema, full, out = "study_id string, v int", "study_id string, v int, identity string, batch bigint", f"{folder}/out"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    written = lambda s: s.read.schema(full).parquet(out)
    done = lambda s, batch: written(s).filter(F.col("batch") != batch).select("study_id", "identity") if os.path.exists(out) else None
    encode = lambda df: df.withColumn("identity", F.lit("id1"))
    sink = lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    run = lambda identity: I.incremental_extract(spark.readStream.schema(schema).parquet(f"{folder}/in"), done, encode, sink, identity, f"{folder}/mark").awaitTermination()
    rows = lambda: {(r.study_id, r.v) for r in written(spark).collect()}

    put([("a", 1), ("b", 2)])
    run("id1")
    put([("b", 99), ("c", 3)])
    run("id1")
    assert rows() == {("a", 1), ("b", 2), ("c", 3)}
    I.extract_batch(spark.createDataFrame([("b", 99), ("c", 3)], schema), 1, done, encode, sink, "id1")  # a replay
    assert rows() == {("a", 1), ("b", 2), ("c", 3)}
    put([("d", 4)])
    with pytest.raises(Exception, match="other_identity"):
        run("id2")


def test_streaming_merge_across_batches(spark, folder):
    schema = "study_id string, slot int, planned_mask bigint"
    out, mark = f"{folder}/out", f"{folder}/mark"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        I.streaming_merge(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()

    run([("a", 0, 5), ("b", 1, 2), ("b", 0, 2)])
    run([("a", 2, 5), ("a", 0, 5)])
    run([("b", 1, 2)])
    got = {(r.kind, r.study_id, r.slot, r.n_slots) for r in spark.read.parquet(out).collect()}
    assert got == {("complete", "b", -1, 1), ("unexpected", "b", 0, 0), ("complete", "a", -1, 2), ("duplicate", "a", 0, 0), ("duplicate", "b", 1, 0)}


def test_streaming_merge_releases_state(spark, folder):
    """Complete and incomplete studies leave no state once the watermark has passed them; what comes later is dropped."""
    schema = "study_id string, slot int, planned_mask bigint, ts timestamp"
    out, mark, rows_left = f"{folder}/out", f"{folder}/mark", []

    def run(rows):
        timed = spark.createDataFrame(rows, "study_id string, slot int, planned_mask bigint, s bigint")
        timed.select("study_id", "slot", "planned_mask", F.timestamp_seconds(F.col("s") + 10 ** 6).alias("ts")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        merged = I.streaming_merge(spark.readStream.schema(schema).parquet(f"{folder}/in"), "ts", "10 minutes", "10 minutes")
        q = merged.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination()
        rows_left.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])

    run([("a", 0, 5, 0), ("b", 0, 3, 10), ("c", 1, 2, 20)])
    run([("a", 2, 5, 300), ("a", 0, 5, 310), ("c", 1, 2, 900)])
    run([("d", 0, 1, 9000)])                      # passes a, b and c
    run([("a", 2, 5, 400), ("c", 1, 2, 400)])     # behind the watermark
    run([("e", 0, 1, 20000)])                     # passes d
    got = sorted((r.kind, r.study_id, r.slot, r.n_slots) for r in spark.read.parquet(out).collect())
    assert got == [("complete", "a", -1, 2), ("complete", "c", -1, 1), ("complete", "d", -1, 1), ("complete", "e", -1, 1),
                   ("duplicate", "a", 0, 0), ("duplicate", "c", 1, 0), ("incomplete", "b", -1, 1)]
    assert rows_left == [3, 3, 1, 1, 1]


def test_merge_rows_follow_their_order():
    slots, masks = np.array([4, 0, 0, 2, 2, 1]), np.array([5, 5, 5, 5, 5, 5])
    out, seen = I._merge_rows("a", slots, masks, 0)
    assert list(zip(out.kind, out.slot, out.n_slots)) == [("unexpected", 4, 0), ("duplicate", 0, 0), ("complete", -1, 2), ("duplicate", 2, 0), ("unexpected", 1, 0)] and seen == 5


def test_empty_study_is_an_error(spark):
    bank, _, _ = make_bank(spark)
    scored = bank.withColumn("c", F.lit(0.0))
    spine = scored.select("study_id").distinct().unionByName(spark.createDataFrame([("empty",)], "study_id string"))
    with pytest.raises(Exception, match="no vectors of study empty"):
        B.attention_pool(scored, ["c"], spine).collect()


def test_vector_duplicates_fold_zero_and_nan(spark):
    nan = float("nan")
    rows = [([0.0, 1.0],), ([-0.0, 1.0],), ([nan],), ([nan],), ([None, 1.0],), ([1.0, None],), (None,), (None,), ([],)]
    got = B.vector_duplicates(spark.createDataFrame(rows, "embedding array<float>")).first()
    assert (got.distinct_vectors, got.duplicate_groups, got.rows_in_groups) == (6, 3, 6)


def test_erf_between_knots():
    import math
    x = np.concatenate([np.linspace(-7, 7, 20001), [1e300, -1e300]])
    assert np.abs(M._erf(x) - np.array([math.erf(v) for v in x])).max() < 1e-11

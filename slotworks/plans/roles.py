"""The role mapping of the driver tables as DataFrames (see FIXTURES.md)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit, labels, ordering, selection
from ..session import spread
from .registry import Tables

LABELS = ["quality", "toxic", "english"]
SOURCES = ["s0", "s1", "s2", "s3"]
PLANES = ["A", "N", "R"]
WEIGHTS = {"s3": 2.0}
WIDTH = 64
IDENTITY = "bank-v1"


def text(c):
    return F.col(c).cast("string")


def fan(values, name):
    return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)


def series(t: Tables) -> DataFrame:
    line = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                             "l_returnflag", "l_linestatus")
    last = audit.latest_per_key(line, ["l_orderkey", "l_linenumber"],
                                ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"])
    return last.select(text("l_orderkey").alias("study_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("series_id"),
                       F.col("l_returnflag").alias("plane"), (F.col("l_linestatus") == "F").cast("int").alias("fat_sup"),
                       F.col("l_quantity").cast("bigint").alias("n"), (F.col("l_partkey") % 7).alias("shard"))


def slotted(t: Tables) -> DataFrame:
    return selection.with_slot(series(t), PLANES)


def selected(t: Tables) -> DataFrame:
    return selection.select_series(selection.usable_series(slotted(t)), carry=["n", "shard"])


def studies(t: Tables) -> DataFrame:
    return t.orders.select(text("o_orderkey").alias("study_id"))


def official(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang")
    marks = t.labels.select("doc_id", "quality", "toxic").withColumn("_gold", F.lit(True))
    english = F.when(F.col("_gold"), (F.col("lang") == "en").cast("double"))
    return docs.join(marks, "doc_id", "left").select(text("doc_id").alias("study_id"), F.col("quality").cast("double").alias("quality"),
                                                    F.col("toxic").cast("double").alias("toxic"), english.alias("english"))


def truth(t: Tables) -> DataFrame:
    gold = official(t).filter("quality IS NOT NULL")
    return labels.unpivot(gold, ["study_id"], LABELS, "label", "y").withColumn("y", F.col("y").cast("bigint"))


def sources(t: Tables) -> DataFrame:
    docs = spread(t.documents.select("doc_id"), "doc_id")
    rows = docs.select(text("doc_id").alias("study_id"), fan(SOURCES, "source")).select("*", fan(LABELS, "label"))
    p = F.round(S.hash_uniform("source", "label", "study_id"), 4)
    silent = S.hash_uniform(F.lit("null"), "source", "label", "study_id") < 0.15
    return rows.select("source", "study_id", "label", F.when(~silent, p).alias("p"))


def soft(t: Tables) -> DataFrame:
    return labels.consensus(sources(t), WEIGHTS)


def grades(t: Tables) -> DataFrame:
    rows = t.documents.select(text("doc_id").alias("study_id"), fan(["Effusion", "Synovitis", "ACL"], "label"))
    return rows.withColumn("grade", (F.floor(S.hash_uniform(F.lit("grade"), "label", "study_id") * 5) - 1).cast("int"))


def predictions(t: Tables) -> DataFrame:
    rows = truth(t).select("*", fan(["a", "b"], "model"))
    noise = F.when(F.col("model") == "a", S.dbl(0.6)).otherwise(S.dbl(0.8))
    pull = F.when(F.col("model") == "a", S.dbl(0.4)).otherwise(S.dbl(0.2))
    score = F.round(noise * S.hash_uniform("model", "label", "study_id") + pull * F.col("y"), 3)
    return rows.select("model", "study_id", "label", score.alias("score"), "y")


def both_models(t: Tables) -> DataFrame:
    """(study_id, label, y, a, b)."""
    p = predictions(t)
    return p.groupBy("study_id", "label", "y").pivot("model", ["a", "b"]).agg(F.first("score"))


def roles(t: Tables) -> DataFrame:
    from ..operators.checks import split_roles
    gold = F.col("quality").isNotNull()
    fold = F.when(gold, F.lit(-1)).otherwise(S.hash_bits(F.lit("fold"), "study_id") % 5)
    return split_roles(official(t).select("study_id", gold.alias("is_gold"), fold.alias("fold")), 0)


def report_roles(t: Tables) -> DataFrame:
    """(study_id, report_key, is_gold, fold, role): no report, nor a copy of it, has two roles."""
    from ..operators.checks import split_roles
    from ..operators.labels import leak_free_folds, with_report_key
    keyed = with_report_key(t.documents.select(text("doc_id").alias("study_id"), "text"), "text").select("study_id", "report_key")
    gold = official(t).select("study_id", F.col("quality").isNotNull().alias("is_gold"))
    return split_roles(leak_free_folds(keyed.join(gold, "study_id")), 0)


def bank(t: Tables) -> DataFrame:
    # 20 vectors fill five of a study's six slots, so every study lacks one
    v = F.col("vec_id")
    sno = F.floor(v / 20)
    slot = ((sno + 1 + F.floor((v % 20) / 4)) % 6).cast("int")
    e = t.embeddings
    sid = sno.cast("string")
    return e.select(sid.alias("study_id"), slot.alias("slot"), (v % 4).cast("int").alias("k"), ((v % 4) / 3).cast("float").alias("position"),
                    F.concat_ws("-", sid, slot.cast("string")).alias("series_id"), ((sno + slot) % 7).cast("int").alias("shard"),
                    F.lit(IDENTITY).alias("identity"), "embedding", F.col("label").cast("bigint").alias("target"))


def partials(t: Tables) -> DataFrame:
    """The bank with a missing shard, moved positions, and copies from another shard."""
    b = bank(t)
    sno = F.col("study_id").cast("bigint")
    keep = b.filter(~((F.col("shard") == 6) & (sno % 2 == 0)))
    keep = keep.withColumn("position", F.when((sno % 10 == 3) & (F.col("k") == 2), F.lit(0.5)).otherwise(F.col("position")).cast("float"))
    copies = b.filter((sno % 4 == 1) & (F.col("slot") == 2)).withColumn("shard", ((F.col("shard") + 1) % 7).cast("int")).withColumn("identity", F.lit("bank-v0"))
    return keep.unionByName(copies)


def headers(t: Tables) -> DataFrame:
    user, event = F.col("user_id"), F.col("event_id")
    at = lambda vals: F.element_at(F.array(*[F.lit(v) for v in vals]), (user % 6 + 1).cast("int"))
    ra, ca = at([0, 0, 1, 1, 2, 2]), at([1, 2, 0, 2, 0, 1])
    sign = lambda d: F.when(F.floor(user / d) % 2 == 0, S.dbl(1)).otherwise(S.dbl(-1))

    def axis(main, s, tilt):
        return [F.when(main == i, s).when((ra != i) & (ca != i), S.dbl(tilt)).otherwise(S.dbl(0)) for i in range(3)]

    o = F.array(*axis(ra, sign(6), 0.1), *axis(ca, sign(12), -0.2))
    v = F.col("value")
    spaced = event % 19 != 0
    return t.events.select(
        text("user_id").alias("series_id"), event.alias("ordinal"), (event % 3).alias("frame"), (event % 97).cast("double").alias("instance"),
        F.when((user % 11 != 0) & (event % 17 != 0), o).alias("orientation"),
        F.when(~((user % 13 == 0) & (event % 7 == 0)), F.array(v, v * 0.5, -v * 2)).alias("ipp"),
        F.when(user % 2 == 0, F.lit("Axial")).alias("plane_name"), v.alias("value"),
        F.when(spaced, F.array(S.dbl(0.25) + (event % 7) / S.dbl(10), S.dbl(0.3) + (event % 5) / S.dbl(10))).alias("spacing"),
        (F.lit(200) + (event % 13) * 24).alias("h"), (F.lit(220) + (event % 11) * 30).alias("w"))


def pixels(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.events.groupBy(text("user_id").alias("series_id"), (e % 16).alias("row"), (F.floor(e / 16) % 16).alias("col")).agg(F.avg("value").alias("value"))


def receipts(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_id").alias("step"), text("user_id").alias("job"), "ts", F.get_json_object("props", "$.k").cast("bigint").alias("images"),
                           F.floor(F.col("value") * 1000000).alias("bytes"), S.utc_micros("ts").alias("us"), (F.col("user_id") % 7).alias("shard"))
    gap = ordering.with_previous(rows, ["job"], [F.col("ts").asc(), F.col("step").asc()], "us", "_before")
    seconds = F.coalesce(F.col("us") - F.col("_before"), F.lit(0)) / S.dbl(1000000)
    return gap.select("step", "job", "ts", "images", "bytes", seconds.alias("seconds"), "shard")


def manifest(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.concat(F.lit("doc/"), text("doc_id"), F.lit(".txt")).alias("member"),
                              F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha"))


def observed(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return manifest(t).filter(d % 97 != 5).select(
        "doc_id", "member", F.when(d % 50 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"),
        F.when(d % 100 == 0, F.substring("sha", 1, 60)).otherwise(F.col("sha")).alias("sha"))

"""Weak labels: alignment, consensus, source quality, report groups and folds."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..functions.text import report_key, words
from ..session import pin, spread
from .evaluate import auc
from .ordering import bucket_bits, with_hash_ordinal

LABELS = ["ACL", "MCL", "Medial Meniscus", "Lateral Meniscus", "Medial OA", "Lateral OA",
          "PF OA", "Effusion", "Synovitis", "Baker's", "Contusion", "Fracture"]

# Probability of a positive reading for the grades -1 (silent), 0, 1, 2, 3.
GRADE_PROBABILITY = {
    "ACL":              [0.10, 0.03, 0.20, 0.70, 0.97],
    "MCL":              [0.08, 0.03, 0.20, 0.70, 0.95],
    "Medial Meniscus":  [0.15, 0.04, 0.25, 0.92, 0.97],
    "Lateral Meniscus": [0.12, 0.04, 0.25, 0.92, 0.97],
    "Medial OA":        [0.06, 0.03, 0.20, 0.75, 0.95],
    "Lateral OA":       [0.05, 0.03, 0.20, 0.75, 0.95],
    "PF OA":            [0.10, 0.03, 0.25, 0.75, 0.95],
    "Effusion":         [0.25, 0.05, 0.35, 0.85, 0.97],
    "Synovitis":        [0.30, 0.10, 0.55, 0.85, 0.95],
    "Baker's":          [0.05, 0.02, 0.30, 0.80, 0.95],
    "Contusion":        [0.15, 0.05, 0.40, 0.90, 0.95],
    "Fracture":         [0.12, 0.05, 0.40, 0.90, 0.97],
}
# Members of a bucket in one block.
BLOCK = 512
_FIELDS = np.uint64(0x5555555555555555)
# Silent synovitis by effusion grade.
SILENT_OVERRIDE = {0: 0.15, 2: 0.45, 3: 0.60}


def align_to_spine(spine: DataFrame, src: DataFrame, keys: list[str]) -> DataFrame:
    """Every spine row once, NULL where the source has none, extras dropped."""
    return spine.select(*keys).join(src, keys, "left")


def unpivot(df: DataFrame, ids: list[str], labels: list[str], name: str = "label", value: str = "value") -> DataFrame:
    typed = df.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in labels])
    return typed.unpivot([F.col(i) for i in ids], [F.col(f"`{c}`") for c in labels], name, value)


def pivot_labels(df: DataFrame, ids: list[str], labels: list[str], value: str, name: str = "label") -> DataFrame:
    """Long to wide with a fixed label list, so no extra job looks for labels."""
    return df.groupBy(*ids).pivot(name, labels).agg(F.first(value, ignorenulls=True))


def grade_to_probability(df: DataFrame, label: str = "label", grade: str = "grade", out: str = "p",
                         table: dict[str, list[float]] = GRADE_PROBABILITY) -> DataFrame:
    """Table lookup at grade + 1; an unknown label or grade stays NULL."""
    rows = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[S.dbl(p) for p in v]))])
    at = F.when(F.col(grade).between(-1, 3), F.col(grade).cast("int") + 2)
    return df.withColumn(out, F.try_element_at(F.try_element_at(rows, F.col(label)), at))


def conditional_override(graded: DataFrame, key: str = "study_id", target: str = "Synovitis",
                         driver: str = "Effusion", values: dict[int, float] = SILENT_OVERRIDE) -> DataFrame:
    """Replace p of silent `target` rows by the grade of `driver` in the study.

    Only the silent rows are shuffled to meet their driver grade.
    """
    silent = (F.col("label") == target) & F.coalesce(F.col("grade") == -1, F.lit(False))
    grades = graded.filter(F.col("label") == driver).select(key, F.col("grade").alias("_driver"))
    chosen = reduce(lambda c, kv: c.when(F.col("_driver") == kv[0], S.dbl(kv[1])), values.items(), F.when(F.lit(False), S.dbl(0)))
    fixed = (graded.filter(silent).join(grades, key, "left")
             .withColumn("p", F.coalesce(chosen, F.col("p"))).drop("_driver").select(*graded.columns))
    return graded.filter(~silent).unionByName(fixed)


def consensus(sources: DataFrame, weights: dict[str, float] | None = None, lo: float = 0.01, hi: float = 0.99,
              keys: tuple[str, ...] = ("study_id", "label")) -> DataFrame:
    """Weighted mean over the sources that speak, clipped; NULL if none does.

    A source without an entry weighs 1; weight 0 drops it.
    """
    w = S.dbl(1)
    for name, value in (weights or {}).items():
        w = F.when(F.col("source") == name, S.dbl(value)).otherwise(w)
    p = S.null_if_nan("p")
    agg = sources.groupBy(*keys).agg(F.sum(w * p).alias("_num"), F.sum(F.when(p.isNotNull(), w)).alias("_den"))
    soft = F.try_divide("_num", "_den")
    return agg.select(*keys, F.when(soft.isNotNull(), F.least(F.greatest(soft, S.dbl(lo)), S.dbl(hi))).alias("p"))


def source_auc(sources: DataFrame, gold: DataFrame, names: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """AUC per source and for the consensus on gold rows; silence scores 0.5.

    gold(study_id, label, y). Adds a MEAN row per source over its defined labels.
    """
    voices = sources.join(gold.select("study_id").distinct(), "study_id", "left_semi").select("source", "study_id", "label", "p")
    voices = voices.unionByName(consensus(voices, weights).select(F.lit("consensus").alias("source"), "study_id", "label", "p"))
    asked = gold.withColumn("source", F.explode(F.array(*[F.lit(n) for n in [*names, "consensus"]])))
    scored = asked.join(voices, ["source", "study_id", "label"], "left").withColumn("p", F.coalesce(S.null_if_nan("p"), S.dbl(0.5)))
    per = auc(scored, ["source", "label"], "p", "y").select("source", "label", "auc")
    mean = per.groupBy("source").agg(F.avg("auc").alias("auc")).select("source", F.lit("MEAN").alias("label"), "auc")
    return per.unionByName(mean)


def label_summary(soft: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean soft label and share at or above the threshold, per label."""
    return soft.groupBy("label").agg(F.count("p").alias("n"), F.avg("p").alias("mean_p"),
                                     F.avg(S.binarize("p", threshold)).alias("positive_fraction"))


def fold_sizes(df: DataFrame, fold: str = "fold") -> DataFrame:
    return df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"))


def source_disagreement(sources: DataFrame, threshold: float = 0.5, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Per label: share of studies whose sources differ at the threshold, share in
    strong conflict, and the mean spread. Studies no source speaks about drop out."""
    p = S.null_if_nan("p")
    span = sources.groupBy("study_id", "label").agg(F.min(p).alias("lo"), F.max(p).alias("hi")).filter("lo IS NOT NULL")
    share = lambda c: F.avg(c.cast("int").cast("double"))
    return span.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), share((F.col("lo") < threshold) & (F.col("hi") >= threshold)).alias("differ_share"),
        share((F.col("lo") <= low) & (F.col("hi") >= high)).alias("conflict_share"), F.avg(F.col("hi") - F.col("lo")).alias("mean_spread"))


def silence_rate(sources: DataFrame) -> DataFrame:
    silent = F.coalesce(F.isnan("p"), F.lit(False)) | F.col("p").isNull()
    return sources.groupBy("source", "label").agg(F.avg(silent.cast("int").cast("double")).alias("silence"))


# ---- report groups ----------------------------------------------------------

def with_report_key(df: DataFrame, text: str, out: str = "report_key") -> DataFrame:
    """Digest of the normalised report, so that shuffles move 64 characters."""
    keyed = [c for c in df.columns if c != text]
    wide = spread(df, *keyed[:1]) if keyed else df
    return wide.withColumn(out, F.sha2(report_key(text), 256))


def report_groups(df: DataFrame, text: str) -> DataFrame:
    return with_report_key(df, text).groupBy("report_key").agg(F.count(F.lit(1)).alias("n_rows"))


def report_group_counts(groups: DataFrame) -> DataFrame:
    many = F.col("n_rows") > 1
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.count_if(many).alias("repeated_groups"),
                      F.coalesce(F.sum(F.when(many, F.col("n_rows"))), F.lit(0)).cast("bigint").alias("rows_in_repeated"))


def template_shingles(df: DataFrame, key: str, text: str, shingle: int = 3) -> DataFrame:
    """(key, _s): hashes of the word shingles of the whole text. A text shorter than one
    shingle is its own only one."""
    tokens = spread(df.select(key, text), key).select(key, words(text).alias("_w"))
    count = F.size("_w")
    # one hash per word first, so that a shingle hash reads three numbers
    hashed = tokens.withColumn("_w", F.transform("_w", lambda w: F.xxhash64(w)))
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), count - shingle)),
                        lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(shingle)]))
    return hashed.select(key, F.when(count >= shingle, grams).otherwise(F.array(F.xxhash64("_w"))).alias("_s"))


def _coded(sets: pa.Array, bands: int, rows: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(digest, band signatures, low two bits of every minimum packed into longs) of each shingle set."""
    lens = pc.list_value_length(sets).to_numpy(zero_copy_only=False)
    flat, n, k = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64), len(lens), bands * rows
    rng = np.random.default_rng(20250301)
    factor, shift = rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)
    ends = np.cumsum(lens)
    low, digests, first = np.zeros((n, k), np.uint32), [], 0
    while first < n:  # about 64k shingles at once stay in the cache
        at = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, at + (1 << 16), side="right")))
        own, heads = flat[at:ends[last - 1]], (ends[first:last] - lens[first:last] - at).astype(np.int64)
        total, mixed = np.add.reduceat(own, heads), np.bitwise_xor.reduceat(_mix(own), heads)
        digests += [f"{x:016x}{y:016x}" for x, y in zip(total.tolist(), mixed.tolist())]
        x = (own >> np.uint64(32)).astype(np.uint32)
        for i in range(k):
            low[first:last, i] = np.minimum.reduceat(x * factor[i] + shift[i], heads)
        first = last
    found = np.zeros((n, bands), np.uint64)
    for r in range(rows):
        found = _mix(found * np.uint64(3) + low[:, r::rows] + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    fields = np.zeros((n, -(-k // 32) * 32), np.uint64)
    fields[:, :k] = (low >> np.uint32(7)) & np.uint32(3)
    return digests, found, (fields.reshape(n, -1, 32) << (2 * np.arange(32, dtype=np.uint64))).sum(2, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def template_signatures(df: DataFrame, key: str, text: str, bands: int = 48, rows: int = 3, shingle: int = 3) -> DataFrame:
    """(key, node, signatures, packed) of every row: the digest of its shingle set, one MinHash
    signature per band, and two bits of every minimum."""
    def longs(x: np.ndarray) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64()))

    def run(batches):
        for b in batches:
            if b.num_rows:
                nodes, found, packed = _coded(b.column("_s"), bands, rows)
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(nodes), longs(found), longs(packed)], [key, "node", "signatures", "packed"])

    sets = template_shingles(df, key, text, shingle).select(key, F.array_distinct("_s").alias("_s"))
    return sets.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, node string, signatures array<bigint>, packed array<bigint>")


def template_bands(signed: DataFrame, key: str) -> DataFrame:
    return signed.select(key, F.posexplode("signatures").alias("band", "signature"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) with component = smallest node, from edges(a, b).

    Alternating large-star / small-star rounds: each round only needs the minimum
    neighbour per node (combined map-side) and one join. Lineage is cut by a
    reliable checkpoint per round.
    """
    e = pin(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = pin(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            heads = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
        before = state


def _agreement(a: str, b: str, minima: int) -> Column:
    """Estimated Jaccard similarity of packed minima, corrected for the quarter that chance gives."""
    def apart(x, y):
        z = x.bitwiseXOR(y)
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(int(_FIELDS))))

    total = F.aggregate(F.zip_with(a, b, apart), F.lit(0), lambda s, v: s + v)
    return (S.dbl(0.75) - total / F.lit(minima)) / S.dbl(0.75)


def _agreements(a: np.ndarray, b: np.ndarray, minima: int) -> np.ndarray:
    """The same as `_agreement`, over numpy rows."""
    x = a ^ b
    return (0.75 - np.bitwise_count((x | (x >> np.uint64(1))) & _FIELDS).sum(-1) / minima) / 0.75


def _template_sets(df: DataFrame, asked: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(node, _s) of the nodes in asked(node, key); only the rows with their keys are read again."""
    keys = asked.select(F.col(key).alias("_key")).distinct()
    few = df.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_semi")

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_coded(b.column("_s"), 1, 1)[0]), b.column("_s")], ["node", "_s"])

    sets = template_shingles(few, key, text, shingle).select(F.array_distinct("_s").alias("_s"))
    return sets.mapInArrow(run, "node string, _s array<bigint>").join(asked.select("node").distinct(), "node", "left_semi")


def _mixed_blocks(members: DataFrame) -> DataFrame:
    """(signature, i, j, node, component, packed if given): members of buckets that hold several components, in pairs of salted blocks.

    Members of a bucket's largest component have blocks of their own, which meet the other blocks only.
    """
    per = members.groupBy("signature", "component").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("_x"))
    found = per.groupBy("signature").agg(F.max(F.struct("_n", "component")).alias("_top"), F.sum("_n").alias("_m"), F.sum("_x").alias("_all"), F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    # buckets of the same members are gone through once
    once = found.groupBy("_m", "_all").agg(F.min("signature").alias("signature"), F.min_by("_top", "signature").alias("_top"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    sized = once.select("signature", F.col("_top.component").alias("_major"), blocks(F.col("_m") - F.col("_top._n")).alias("_few"), blocks(F.col("_top._n")).alias("_many"))
    own, major = members.join(sized, "signature"), F.col("component") == F.col("_major")
    dealt = own.withColumn("_b", F.when(major, F.col("_few") + F.pmod(F.xxhash64("node", "signature"), F.col("_many"))).otherwise(F.pmod(F.xxhash64("node", "signature"), F.col("_few"))).cast("int"))
    met = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_few") - 1 + F.when(major, F.lit(0)).otherwise(F.col("_many")))))
    return met.select("signature", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), "node", "component", *[c for c in members.columns if c == "packed"])


def _block_partners(blocks: DataFrame, minima: int, least: float) -> DataFrame:
    """The rows of blocks whose estimate with a row of another component in their pair of blocks reaches `least`."""
    def run(pdf):
        packed, parts = np.stack(pdf["packed"].to_numpy()).view(np.uint64), pdf["component"].to_numpy()
        hit = [((_agreements(packed, packed[r], minima) >= least) & (parts != parts[r])).any() for r in range(len(pdf))]
        return pdf[np.array(hit, bool)]

    return blocks.groupBy("signature", "i", "j").applyInPandas(run, blocks.schema)


def _block_links(rows: DataFrame, minima: int, least: float, similarity: float) -> DataFrame:
    """(a, b): a spanning forest of the links between components within each pair of blocks."""
    def run(pdf):
        nodes, parts, sets = pdf["node"].tolist(), pdf["component"].tolist(), [np.unique(np.asarray(s)) for s in pdf["_s"]]
        packed, up, out = np.stack(pdf["packed"].to_numpy()).view(np.uint64), {c: c for c in parts}, []

        def top(c):
            while up[c] != c:
                c = up[c]
            return c

        for x in range(len(nodes)):
            for y in np.flatnonzero(_agreements(packed[x + 1:], packed[x], minima) >= least) + x + 1:
                p, q = top(parts[x]), top(parts[y])
                if p != q:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if both >= similarity * (len(sets[x]) + len(sets[y]) - both):
                        up[p] = q
                        out.append((nodes[x], nodes[y]))
        return type(pdf)(out, columns=["a", "b"])

    return rows.groupBy("signature", "i", "j").applyInPandas(run, "a string, b string")


def near_template_groups(df: DataFrame, key: str, text: str, bands: int = 48, rows: int = 3, shingle: int = 3, similarity: float = 0.6) -> DataFrame:
    """(key, template): texts joined through MinHash bands and a Jaccard similarity of
    their shingle sets; the template is the smallest key of the group.

    Texts with equal sets are one node of the graph, whatever their number. Every
    member of a band bucket meets the bucket's smallest node first, m - 1 candidates
    for m members, and its three best estimates are compared in full. Buckets that
    then still hold several components are gone through in pairs of salted blocks, so
    that no pair of a bucket is left out. At the defaults a pair at `similarity` shares
    no band with probability (1 - 0.6**3)**48, about 8.5e-6, and the estimates let go
    of it with less. Every text is kept; a text without a partner is its own template.
    """
    minima = bands * rows
    least = similarity - 4.5 * float(np.sqrt((0.25 + 0.75 * similarity) * 0.75 * (1 - similarity) / minima)) / 0.75
    signed = pin(template_signatures(df, key, text, bands, rows, shingle))
    heads = pin(signed.groupBy("node").agg(F.min(key).alias(key), F.any_value("signatures").alias("signatures"), F.any_value("packed").alias("packed")))
    # digests are shuffled once per band as 16 bytes, not as 32 hex digits; their order is the same
    short, long = lambda c: F.unhex(c).alias(c), lambda c: F.lower(F.hex(c)).alias(c)
    banded, codes = heads.select(short("node"), F.explode("signatures").alias("signature")), heads.select("node", "packed")
    first = banded.groupBy("signature").agg(F.min("node").alias("_first"), F.count(F.lit(1)).alias("_m")).filter("_m > 1")
    pairs = banded.join(first, "signature").filter("node != _first").select(F.col("node").alias("a"), F.col("_first").alias("b")).distinct().select(long("a"), long("b"))
    rated = (pairs.join(codes.select(F.col("node").alias("a"), F.col("packed").alias("_p")), "a").join(codes.select(F.col("node").alias("b"), F.col("packed").alias("_q")), "b")
             .withColumn("_e", _agreement("_p", "_q", minima)).filter(F.col("_e") >= least))
    # a node has one head per band at the most; what is left out here is met in the blocks
    best = pin(rated.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("_e"), "b"))).filter("_r <= 3").select("a", "b"))
    keyed = heads.select("node", key)
    sets = _template_sets(df, best.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(keyed, "node"), key, text, shingle)
    both = F.size(F.array_intersect("_x", "_y"))
    links = pin(best.join(sets.select(F.col("node").alias("a"), F.col("_s").alias("_x")), "a").join(sets.select(F.col("node").alias("b"), F.col("_s").alias("_y")), "b")
                .filter(both >= S.dbl(similarity) * (F.size("_x") + F.size("_y") - both)).select("a", "b"))
    parts = connected_components(links)
    placed = heads.select("node", "packed", "signatures").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # minima follow the members of mixed buckets only: most members are in none
    members = placed.select(F.explode("signatures").alias("signature"), short("node"), short("component"))
    blocks = _mixed_blocks(members).select("signature", "i", "j", long("node"), long("component"))
    open_ = pin(_block_partners(blocks.join(codes, "node"), minima, least))
    sets = _template_sets(df, open_.select("node").distinct().join(keyed, "node"), key, text, shingle)
    more = pin(_block_links(open_.join(sets, "node"), minima, least, similarity))
    if not more.isEmpty():
        parts = connected_components(links.unionByName(more))
    grouped = keyed.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = grouped.select("node", "component").join(grouped.groupBy("component").agg(F.min(key).alias("template")), "component").select("node", "template")
    return signed.select(key, "node").join(named, "node").select(key, "template").distinct()


# ---- grouped folds ----------------------------------------------------------

def fold_schedule(histogram: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Largest-first assignment to the lightest fold, per class of equal size.

    Returns pieces (size, first, last_exclusive, cycle): the group with ordinal o
    in its class goes to cycle[(o - first) % len(cycle)]. Equal groups are
    interchangeable, so one class needs at most k pieces.
    """
    load, pieces = [0] * k, []
    for size, count in sorted(histogram, reverse=True):
        done, active = 0, 1
        while done < count:
            order = sorted(range(k), key=lambda f: (load[f], f))
            # folds that take turns until the next heavier one becomes the lightest
            front = [f for f in order if (load[f], f) < (load[order[0]] + size, order[0])]
            rest = [f for f in order if f not in front]
            take = count - done
            if rest:
                limit = (load[rest[0]], rest[0])
                turns = lambda f: ((limit[0] - load[f]) // size + 1 if f < limit[1] else -(-(limit[0] - load[f]) // size))
                room = sum(turns(f) for f in front)
                take = min(take, room)
            pieces.append((size, done, done + take, front))
            for i, f in enumerate(front):
                load[f] += size * (take // len(front) + (1 if i < take % len(front) else 0))
            done += take
    return pieces


def group_folds(df: DataFrame, group: str, k: int = 5, out: str = "fold", hash_bits: int | None = None) -> DataFrame:
    """Rows of a group share a fold; folds balanced by row count. NULL is a group of its own.

    Only the size histogram (at most sqrt(2 * rows) entries) reaches the driver.
    """
    spark = df.sparkSession
    # read four times below; the group table is far smaller than what made the key
    sizes = pin(df.groupBy(group).agg(F.count(F.lit(1)).alias("_size")))
    histogram = [(r[0], r[1]) for r in sizes.groupBy("_size").count().collect()]
    plan = spark.createDataFrame(fold_schedule(histogram, k), "_size bigint, _first bigint, _last bigint, _cycle array<int>")
    bits = hash_bits or bucket_bits(sum(c for _, c in histogram))
    numbered = with_hash_ordinal(sizes.withColumn("_h", S.hash_bits(group)), "_h", [group], "_o", bits, ["_size"])
    if len(histogram) * k <= 100_000:  # checked size
        plan = F.broadcast(plan)
    at = (F.col("_o") >= F.col("_first")) & (F.col("_o") < F.col("_last"))
    chosen = (numbered.join(plan, "_size").filter(at)
              .select(group, F.element_at("_cycle", ((F.col("_o") - F.col("_first")) % F.size("_cycle") + 1).cast("int")).alias(out)))
    chosen = chosen.withColumnRenamed(group, "_group")
    return df.join(chosen, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def leak_free_folds(df: DataFrame, gold: str = "is_gold", group: str = "report_key", k: int = 5, out: str = "fold") -> DataFrame:
    """Folds of a label table: gold rows are -1, weak rows get grouped folds, and a weak
    row that shares its group with a gold row gets NULL, so that no group has two roles."""
    held = df.filter(F.col(gold)).select(F.col(group).alias("_key")).distinct().withColumn("_held", F.lit(True))
    marked = df.join(held, F.col(group).eqNullSafe(F.col("_key")), "left").drop("_key")
    free = ~F.col(gold) & F.col("_held").isNull()
    folded = group_folds(marked.filter(free), group, k, out).select(*df.columns, F.col(out).cast("int").alias(out))
    rest = marked.filter(~free).select(*df.columns, F.when(F.col(gold), F.lit(-1)).cast("int").alias(out))
    return folded.unionByName(rest)

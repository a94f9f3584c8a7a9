"""b-bit MinHash near-duplicates over 5-word shingles, confirmed on full sets.

1. Every text gives `bands * rows` minima. A band's key hashes its full minima; of each minimum
   the low two bits are packed into longs.
2. Texts with one shingle set collapse to their smallest key. Keys of a band that hold two or
   more components are buckets; in a bucket a member meets the head only (m - 1 candidates, not
   all pairs). Equal packed fields are counted by bit counts, corrected for chance agreement, and
   each member's three best estimates are confirmed on the full sets. A few bands come first, so
   that large groups of near copies are one component when all bands are looked at.
3. Buckets that still hold several components are gone through in blocks: packed signatures
   leave the members with a possible partner elsewhere, and full sets decide. A block gives a
   spanning forest at most, and no pair of a bucket is left out.

A pair at the threshold shares no band with probability (1 - 0.75**5)**50, about 1.3e-6; an
estimate errs below `slack` with about as little. Components use large-star / small-star rounds.

Edge cases: a null or empty text has no shingle, is linked with nothing and is kept; with fewer
words than a shingle the whole sequence is the only one; a null key is linked with nothing, has
a null component and is kept; rows that repeat key and text share their component; texts of any
length are read whole; an empty table gives an empty result. Other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.labels import connected_components
from .common import arrow_bytes, bloom_hit, bloom_words, pin, releasing
from .words import BASES, Words, slices, window_hashes

WIDTH, BANDS, ROWS, PERCENT = 5, 50, 5, 75
FIRST_BANDS = 16
BLOCK = 512
#: Bytes and rows of a slice: short texts have as many minima as long ones.
SLICE, SLICE_ROWS = 1 << 20, 2048
_FIELDS = np.uint64(0x5555555555555555)
_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << 1) | 1
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(flat: pa.Array, most: int = 1 << 17) -> np.ndarray:
    """A 64-bit hash per word, by prefix sums over the bytes of words that stand side by side, `most` bytes (or one longer word) at once."""
    out, first = np.zeros(len(flat), np.uint64), 0
    if not len(flat):
        return out
    _, at, data = flat.buffers()
    at = np.frombuffer(at, np.int64)[flat.offset:flat.offset + len(flat) + 1]
    data = np.frombuffer(data, np.uint8)
    while first < len(flat):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        # one more than the byte, so that a zero byte counts
        values = data[at[first]:at[last]].astype(np.uint64) + np.uint64(1)
        out[first:last] = window_hashes(values, at[first:last] - at[first], np.diff(at[first:last + 1]), BASES[1])
        first = last
    return out


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = Words(texts, lower=True)
    values = word_hashes(words.flat)
    starts = words.window_starts(width)
    hashes = window_hashes(values, starts, width)
    ends = np.searchsorted(starts, words.start)
    sets = [np.unique(hashes[a:b]) for a, b in zip(ends, ends[1:])]
    for i in np.flatnonzero((words.n > 0) & (words.n < width)):
        a, n = words.start[i], int(words.n[i])
        sets[i] = window_hashes(values[a:a + n], np.zeros(1, np.int64), n) ^ np.uint64(n)
    return sets


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, packed low bits) per set; rows of empty sets are zero."""
    n, k = len(sets), BANDS * ROWS
    keys, packed = np.zeros((n, BANDS), np.uint64), np.zeros((n, -(-k // 32)), np.uint64)
    full = np.flatnonzero([len(s) > 0 for s in sets])
    group, size = [], 0
    for at, i in enumerate(full):  # about 64k shingles at once stay in the cache
        group.append(i)
        size += len(sets[i])
        if size >= 1 << 16 or at == len(full) - 1:
            x = (np.concatenate([sets[j] for j in group]) >> np.uint64(32)).astype(np.uint32)
            first = np.concatenate([[0], np.cumsum([len(sets[j]) for j in group])[:-1]])
            y, low = np.empty_like(x), np.zeros((len(group), k), np.uint32)
            for p in range(k):
                np.multiply(x, _A[p], out=y)
                y += _B[p]
                low[:, p] = np.minimum.reduceat(y, first)
            # what is per minimum is kept for one group only
            own = np.zeros((len(group), BANDS), np.uint64)
            for r in range(ROWS):
                own = _mix(own * np.uint64(3) + low[:, r::ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            keys[group] = own
            fields = np.zeros((len(group), 32 * packed.shape[1]), np.uint64)
            fields[:, :k] = (low >> np.uint32(7)) & np.uint32(3)
            fields <<= np.tile(2 * np.arange(32, dtype=np.uint64), packed.shape[1])
            packed[group] = fields.reshape(len(group), -1, 32).sum(2, dtype=np.uint64)
            group, size = [], 0
    return keys, packed


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of packed signatures: agreement beyond the quarter that chance gives."""
    x = a ^ b
    apart = np.bitwise_count((x | (x >> np.uint64(1))) & _FIELDS).sum(-1)
    return (1 - apart / (BANDS * ROWS) - 0.25) / 0.75


def signed(df: DataFrame, key: str, text: str, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, n, set_a, set_b, bands, packed, also...): one row per row of df."""
    @releasing
    def run(batches):
        for part in (p.slice(at, SLICE_ROWS) for p in slices(batches, "text", SLICE) for at in range(0, p.num_rows, SLICE_ROWS)):
            sets = shingle_sets(part.column("text"))
            bands, packed = signatures(sets)
            yield pa.RecordBatch.from_arrays([
                part.column("key"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([int(s.sum(dtype=np.uint64)) for s in sets], pa.uint64()).view(pa.int64()),
                pa.array([int(np.bitwise_xor.reduce(_mix(s))) if len(s) else 0 for s in sets], pa.uint64()).view(pa.int64()),
                pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64())),
                pa.FixedSizeListArray.from_arrays(pa.array(packed.view(np.int64).ravel()), packed.shape[1]).cast(pa.list_(pa.int64()))]
                + [part.column(c) for c in also], ["key", "n", "set_a", "set_b", "bands", "packed", *also])

    shape = f"key {df.schema[key].dataType.simpleString()}, n bigint, set_a bigint, set_b bigint, bands array<bigint>, packed array<bigint>"
    return df.select(F.col(key).alias("key"), F.col(text).alias("text"), *also).mapInArrow(
        run, ", ".join([shape, *(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in also)]))


def _estimate(a: str, b: str):
    """The same as `similarity`, over two array columns."""
    def apart(x, y):
        z = x.bitwiseXOR(y)
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(int(_FIELDS))))

    total = F.aggregate(F.zip_with(a, b, apart), F.lit(0), lambda s, v: s + v)
    return (0.75 - total / F.lit(BANDS * ROWS)) / 0.75


def full_sets(df: DataFrame, keys: DataFrame, key: str, text: str) -> DataFrame:
    """(key, shingles) of at least the rows whose key is in `keys`, and few others."""
    found = bloom_words(keys, "key")

    @releasing
    def run(batches):
        for part in slices(batches, "text", SLICE):
            part = part.filter(pa.array(bloom_hit(part.column("_h").to_numpy(), found)))
            if part.num_rows:
                sets = shingle_sets(part.column("text"))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = np.concatenate(sets).view(np.int64) if ends[-1] else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["key", "shingles"])

    kind = df.schema[key].dataType.simpleString()
    return (df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(key).alias("_h"))
            .mapInArrow(run, f"key {kind}, shingles array<bigint>").join(keys, "key", "left_semi"))


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the candidate pairs that reach the threshold on full sets."""
    wide = (pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("_x")), "a")
            .join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("_y")), "b"))
    both = F.size(F.array_intersect("_x", "_y"))
    return wide.filter(100 * both >= PERCENT * (F.size("_x") + F.size("_y") - both)).select("a", "b")


def _apart(groups: DataFrame) -> DataFrame:
    """Groups (bucket, i, j) over a set number of tasks: they are few bytes and much work, so merging them by size would leave one task."""
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.repartition(tasks, "bucket", "i", "j").groupBy("bucket", "i", "j")


def _blocks(rows: DataFrame) -> DataFrame:
    """Members of a bucket dealt into blocks by hash, each pair of blocks a group (bucket, i, j) of its own."""
    sized = rows.join(rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_n")), "bucket")
    own = sized.withColumn("_b", F.pmod(F.xxhash64("key", "bucket"), F.col("_n")).cast("int"))
    return (own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
            .select(*rows.columns, F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j")))


def possible_partners(members: DataFrame, slack: float) -> DataFrame:
    """(bucket, i, j, key, component) of the members whose estimate with a member of another component reaches `slack`."""
    def run(pdf):
        packed, parts = np.stack(pdf["packed"].to_numpy()).view(np.uint64), pdf["component"].to_numpy()
        hit, step = np.zeros(len(pdf), bool), 64
        for r in range(0, len(pdf), step):
            near = similarity(packed[r:r + step, None], packed[None]) >= slack
            hit[r:r + step] = (near & (parts[r:r + step, None] != parts[None])).any(1)
        return pdf.loc[hit, ["bucket", "i", "j", "key", "component"]]

    kind = members.schema["key"].dataType.simpleString()
    return _apart(_blocks(members)).applyInPandas(run, f"bucket bigint, i int, j int, key {kind}, component {kind}")


def block_links(rows: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the links between components within each group (bucket, i, j)."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(pdf):
        keys, sets = pdf["key"].tolist(), [np.asarray(s).view(np.uint64) for s in pdf["shingles"]]
        sizes, up = np.array([len(s) for s in sets]), {c: c for c in pdf["component"]}
        parts = pdf["component"].tolist()

        def top(c):
            while up[c] != c:
                c = up[c]
            return c

        out = []
        order = np.argsort(sizes, kind="stable")
        for at, x in enumerate(order):
            for y in order[at + 1:]:
                if 100 * sizes[x] < PERCENT * sizes[y]:
                    break  # sets this much larger cannot reach the threshold
                p, q = top(parts[x]), top(parts[y])
                if p != q and _linked(sets[x], sets[y]):
                    up[p] = q
                    out.append((keys[x], keys[y]))
        return type(pdf)(out, columns=["a", "b"])

    return _apart(rows).applyInPandas(run, f"a {kind}, b {kind}")


def _placed(reps: DataFrame, parts: DataFrame | None) -> DataFrame:
    """(key, component, size, bands, packed) of the distinct sets; a set is its own component until it is linked."""
    own = reps.select(F.col("rep").alias("key"), "bands", "packed")
    if parts is None:
        return own.withColumns({"component": F.col("key"), "size": F.lit(1).cast("bigint")})
    sized = parts.join(parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component")
    return own.join(sized, "key", "left").withColumns({"component": F.coalesce("component", "key"), "size": F.coalesce("size", F.lit(1))})


def _mixed(rows: DataFrame) -> DataFrame:
    """(bucket, head, head_component, members) of the buckets that hold several components; the head is of the largest one."""
    head = F.min(F.struct((-F.col("size")).alias("_s"), "component", "key"))
    same = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("key").cast("decimal(38,0)")))
    found = rows.groupBy("bucket").agg(head.alias("_h"), F.min("component").alias("_c"), F.max("component").alias("_d"), same.alias("members")).filter("_c != _d")
    return found.select("bucket", F.col("_h.key").alias("head"), F.col("_h.component").alias("head_component"), "members")


def _banded(placed: DataFrame, bands: int) -> DataFrame:
    return placed.select(F.explode(F.slice("bands", 1, bands)).alias("bucket"), "key", "component", "size")


def in_buckets(placed: DataFrame, bands: int, buckets: DataFrame) -> DataFrame:
    """(bucket, key, component) of the members of at least the buckets in `buckets`, and few others: lists are thinned out before they become rows."""
    found = bloom_words(buckets, "bucket", hashed=False)

    @releasing
    def run(batches):
        for b in batches:
            lists = b.column("buckets")
            flat = lists.flatten()
            hit = np.flatnonzero(bloom_hit(flat.to_numpy(), found))
            owner = pa.array(np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())[hit])
            yield pa.RecordBatch.from_arrays([flat.take(pa.array(hit)), b.column("key").take(owner), b.column("component").take(owner)], ["bucket", "key", "component"])

    kind = placed.schema["key"].dataType.simpleString()
    return (placed.select(F.slice("bands", 1, bands).alias("buckets"), "key", "component")
            .mapInArrow(run, f"bucket bigint, key {kind}, component {kind}"))


def star_links(df: DataFrame, placed: DataFrame, bands: int, key: str, text: str, slack: float) -> DataFrame:
    """(a, b): links between the heads of mixed buckets and the members outside the head's component."""
    banded, codes = _banded(placed, bands), placed.select("key", "packed")
    # of known size from here on, so that a short list is broadcast
    heads = pin(_mixed(banded).select("bucket", "head", "head_component"), "heads")
    met = in_buckets(placed, bands, heads).join(heads, "bucket").filter("component != head_component")
    pairs = met.select(F.col("key").alias("a"), F.col("head").alias("b")).distinct()
    rated = (pairs.join(codes.select(F.col("key").alias("a"), F.col("packed").alias("_p")), "a")
             .join(codes.select(F.col("key").alias("b"), F.col("packed").alias("_q")), "b")
             .withColumn("_e", _estimate("_p", "_q")).filter(F.col("_e") >= slack))
    # a member has one head per band at the most, so these windows hold 50 rows
    best = rated.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("_e"), "b"))).filter("_r <= 3")
    chosen = pin(best.select("a", "b"), "pairs")
    ends = chosen.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    return pin(confirmed(chosen, full_sets(df, ends, key, text)), "links")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", slack: float = 0.58, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, n_shingles, component_id, kept, also...): one row per row of df; kept where the key is its component's smallest."""
    # all steps in Python are pinned before this returns
    with arrow_bytes(df.sparkSession):
        return _near_duplicates(df, key, text, slack, also)


def _near_duplicates(df: DataFrame, key: str, text: str, slack: float, also: tuple[str, ...]) -> DataFrame:
    sig = pin(signed(df, key, text, also), "signatures")
    known = sig.filter("n > 0 AND key IS NOT NULL")
    heads = known.groupBy("set_a", "set_b", "n").agg(F.min("key").alias("rep"), F.min_by(F.struct("bands", "packed"), "key").alias("_s"))
    reps = pin(heads.select("set_a", "set_b", "n", "rep", "_s.bands", "_s.packed"), "sets")

    links, parts = None, None
    # a few bands join most copies; the others then meet in mixed buckets only
    for bands in (FIRST_BANDS, BANDS):
        more = star_links(df, _placed(reps, parts), bands, key, text, slack)
        links = more if links is None else links.unionByName(more)
        parts = connected_components(links).select(F.col("node").alias("key"), "component")

    placed = _placed(reps, parts)
    banded = _banded(placed, BANDS)
    # buckets of the same members are gone through once
    once = pin(_mixed(banded).groupBy("members").agg(F.min("bucket").alias("bucket")).select("bucket"), "open")
    members = pin(in_buckets(placed, BANDS, once).join(once, "bucket").join(placed.select("key", "packed"), "key"), "members")
    flagged = pin(possible_partners(members, slack), "partners")
    more = pin(block_links(flagged.join(full_sets(df, flagged.select("key").distinct(), key, text), "key")), "block-links")
    if not more.isEmpty():
        parts = connected_components(links.unionByName(more)).select(F.col("node").alias("key"), "component")

    named = reps.select("set_a", "set_b", "n", "rep").join(parts, F.col("rep") == F.col("key"), "left").select(
        "set_a", "set_b", "n", F.coalesce("component", "rep").alias("component_id"))
    out = sig.select("key", "n", "set_a", "set_b", *also).join(named, ["set_a", "set_b", "n"], "left")
    part = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    return (out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), part).alias("component_id"),
                       F.coalesce(F.col("key") == part, F.lit(True)).alias("kept"), *also))

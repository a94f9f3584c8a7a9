"""Spelling variants: words one edit apart, found by dynamic programming along sorted lists.

1. Runs of Latin letters of whole texts are counted, per slice of input first.
2. Of two words one edit apart, of which the shorter one has `low` code points, the first or the
   last `low // 2` code points are the same. So every word joins lists (side, low, half): by its
   beginning, and by its end written backwards. Words of a list have `low` or `low + 1` code points.
   Lists longer than `most` are dealt anew by a further piece: of the rest, one half is the same as
   well. No pair is left out, and a pair is found in one list only.
3. A list is sorted. Each word runs along the words behind it through a banded edit matrix (the
   three cells around the diagonal): the rows that a word shares with the one before it (their
   longest common prefix) are kept, and once all cells of a row exceed one edit, the range of words
   that share that prefix is skipped.
4. A word's form is its most frequent near word, where that is `ratio` times as frequent; chains of
   forms are followed by pointer doubling (they end, as counts grow by `ratio`).

Edge cases: null and empty texts have no word; a null key counts as an empty one in `thin_out`;
repeated rows count again; ties of counts go to the smaller word; texts of any length are read
whole; an empty table gives an empty result. Other columns are not read.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin
from .runs import latin_runs
from .words import slices

LEAST_LENGTH, LEAST_COUNT, RATIO, EVERY = 6, 5, 5, 199
MOST = 4096
SLICE = 16 << 20


def thin_out(run: bytes, h: int) -> bytes:
    """The run without its code point h % length."""
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1:]).encode()


def vocabulary(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LEAST_LENGTH, least: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n) of the words of at least `length` code points and `least` occurrences.

    A run whose crc32 of "<key>:<run>" is a multiple of `every` loses one code point first.
    """
    def run(batches):
        for part in slices(batches, "text", SLICE):
            words = latin_runs(part.column("text"))
            if not len(words.flat):
                continue
            coded = words.flat.dictionary_encode()
            known, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            long = pc.greater_equal(pc.utf8_length(known), length).to_numpy(zero_copy_only=False)
            raw = known.cast(pa.large_binary()).to_pylist()
            keep = long[code]
            both, times = np.unique(words.owner[keep] << 32 | code[keep], return_counts=True)
            seeds = [zlib.crc32(f"{k or ''}:".encode()) for k in part.column("key").to_pylist()]
            doc, at = both >> 32, both & 0xFFFFFFFF
            h = np.fromiter((zlib.crc32(raw[w], seeds[d]) for d, w in zip(doc.tolist(), at.tolist())), np.int64, len(both))
            hit = h % every == 0
            n = np.bincount(at[~hit], times[~hit], len(raw)).astype(np.int64)
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([known.take(pa.array(there)).cast(pa.string()), pa.array(n[there])], ["word", "n"])
            cut = [(thin_out(raw[w], c), t) for w, c, t in zip(at[hit].tolist(), h[hit].tolist(), times[hit].tolist())]
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in cut]), pa.array([t for _, t in cut], pa.int64())], ["word", "n"])

    # the key as text, so that a key of any type goes into the checksum as it is written
    counted = (df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(run, "word string, n bigint")
               .groupBy("word").agg(F.sum("n").alias("n")))
    return counted.filter((F.col("n") >= least) & (F.length("word") >= length))


def neighbours(words: list[str], shared: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j), i < j, of the sorted distinct words that are one edit apart; all share `shared` first characters."""
    common = [0] * len(words)
    for k in range(1, len(words)):
        a, b, n = words[k - 1], words[k], shared
        while n < len(a) and n < len(b) and a[n] == b[n]:
            n += 1
        common[k] = n
    end = len(words)
    for i, q in enumerate(words):
        size = len(q)
        # cells D[d][d - 1], D[d][d], D[d][d + 1] of each row d, the number of characters of the list's word
        rows: list[tuple[int, int, int]] = [(1, 0, 1)] * (size + 2)
        depth, j = shared, i + 1  # rows up to `depth` hold for the word before j
        while j < end:
            v = words[j]
            depth = min(depth, common[j]) if j > i + 1 else shared
            a, b, c = rows[depth]
            dead, stop = False, len(v)
            while depth < stop:
                x = v[depth]
                na = min(a + (depth == 0 or depth > size or x != q[depth - 1]), b + 1)
                nb = min(b + (depth >= size or x != q[depth]), c + 1, na + 1)
                c = min(c + (depth + 1 >= size or x != q[depth + 1]), nb + 1)
                a, b = na, nb
                depth += 1
                if a > 1 and b > 1 and c > 1:
                    dead = True
                    break
                rows[depth] = (a, b, c)
            if dead:
                # no word with these `depth` characters can be near; rows above stay valid
                j += 1
                while j < end and common[j] >= depth:
                    j += 1
                depth -= 1
                continue
            if abs(size - stop) <= 1 and (a, b, c)[size - stop + 1] == 1:
                yield i, j
            j += 1


def _listed(words: DataFrame) -> DataFrame:
    """(side, low, half, more, word): each word in its four lists; words at the end side are written backwards."""
    both = words.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("word")),
                                          F.struct(F.lit(1).alias("side"), F.reverse("word").alias("word")))).alias("s")).select("s.*")
    n = F.length("word")
    low = both.withColumn("low", F.explode(F.array(n, n - 1)))
    return low.withColumn("half", F.expr("substring(word, 1, low div 2)"))


def _dealt(words: DataFrame, most: int) -> DataFrame:
    """The lists of at least two words, those longer than `most` split by a further piece (more = 1: next to the half, 2: at the other end)."""
    listed = _listed(words)
    sizes = listed.groupBy("side", "low", "half").agg(F.count(F.lit(1)).alias("size"), F.min(F.length("word")).alias("_least")).filter("size > 1 AND _least = low")
    lists = listed.join(sizes, ["side", "low", "half"])
    piece = "(low - low div 2) div 2"
    finer = F.when(F.col("size") <= most, F.array(F.struct(F.lit(0).alias("more"), F.lit("").alias("piece")))).otherwise(F.array(
        F.struct(F.lit(1).alias("more"), F.expr(f"substring(word, low div 2 + 1, {piece})").alias("piece")),
        F.struct(F.lit(2).alias("more"), F.expr(f"right(word, {piece})").alias("piece"))))
    return lists.withColumn("f", F.explode(finer)).select("side", "low", "half", "f.more", "f.piece", "word")


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): every unordered pair of the distinct words that is one edit apart, once."""
    def scan(side: int, low: int, more: int, group: list[str]):
        turned = more == 2  # these share the half and the end
        half, piece = low // 2, (low - low // 2) // 2
        for i, j in neighbours(group, half + (piece if more == 1 else 0)):
            v, w = group[i], group[j]
            if len(v) > low and len(w) > low:
                continue  # both are in the list of their own length
            if turned and v[half:half + piece] == w[half:half + piece]:
                continue  # found by the piece next to the half
            if side == 1:
                v, w = v[::-1], w[::-1]
                if v[:half] == w[:half]:
                    continue  # found from the beginning
            yield (v, w) if v < w else (w, v)

    def run(batches):
        last, group, out = None, [], []
        names = ["side", "low", "more", "half", "piece", "word"]

        def flush():
            pairs, out[:] = list(out), []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for side, low, more, half, piece, word in zip(*(batch.column(c).to_pylist() for c in names)):
                now = (side, low, more, half, piece)
                if now != last:
                    if len(group) > 1:
                        out += scan(*last[:3], group)
                    last, group = now, []
                group.append(word)
                if len(out) >= 1 << 16:
                    yield flush()
        if len(group) > 1:
            out += scan(*last[:3], group)
        yield flush()

    keys = ["side", "low", "more", "half", "piece"]
    laid = _dealt(words, most).repartition(*keys).sortWithinPartitions(*keys, "word")
    return laid.mapInArrow(run, "a string, b string")


def followed(forms: DataFrame, rounds: int = 5) -> DataFrame:
    """(word, root): the end of each word's chain of forms. Counts grow fivefold a step, so 2**5 steps are never needed."""
    jump = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        ahead = jump.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jump = pin(jump.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
        if jump.join(jump.select(F.col("word").alias("root")), "root", "left_semi").isEmpty():
            break
    return jump


def spelling_variants(df: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = RATIO, most: int = MOST, **how) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of df."""
    words = pin(vocabulary(df, key, text, **how), "vocabulary")
    pairs = pin(near_words(words, most), "near-words")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("e")).select("e.*")
    counted = ends.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("_b"))
    judged = words.join(best, "word", "left").withColumn("_ok", -F.col("_b.m") >= F.lit(ratio) * F.col("n"))
    full = pin(judged.select("word", F.when(F.col("_ok"), F.col("_b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                             F.when(F.col("_ok"), -F.col("_b.m")).alias("form_n")), "forms")
    roots = followed(full.filter("form IS NOT NULL"))
    return full.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

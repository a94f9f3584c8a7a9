"""Substring dedup: 50-word windows that already occur in a document with a smaller key are cut.

1. Anchors. A difference cover D modulo v holds, for any two positions, one offset below v that
   takes both into D. So two equal windows of 50 words hold, at the same offset, an anchor window
   of 50 - v + 1 words that starts in D modulo v in both documents. Only these anchors (6 of 31
   positions) are hashed and shuffled; those found in two documents mark where to look.
2. Extension. The windows around marked anchors are hashed in full, with 128 bits, and each
   hash gets its smallest key. A window is cut where that key is smaller than its own.

Whole copies: a text equal to one under a smaller key is cut whole and takes no part in the
search, which its smallest key stands for.

Hot passages: a task first settles what repeats within its slice of the input. Of one hash it
sends one anchor, and the windows of the smallest key only; all others are known to be shared
or cut already. So a hash reaches the shuffle once per slice, not once per document.

The texts are shuffled by key once; anchors, windows and the final cut read the same exchange,
which is why each join below keeps all columns and all rows of that side.

Edge cases: a null text has no words and stays null; texts below one window, and rows with a null
key, lose nothing; equal windows within one document are no copies. A key names one text: rows
that repeat it count as one document and each is returned, and where their texts differ, a cut
found in one applies to the others where it fits. Texts of any length are read whole; an empty
table gives an empty result; other columns are passed through, and `n_words` and `n_removed`
replace columns of these names.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import releasing
from .words import BASES, Words, covered, slices, window_hashes

WIDTH = 50
#: A perfect difference set: every non-zero remainder modulo 31 is the difference of two of these.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
SLICE = 16 << 20
#: Bytes of text whose words are laid out at once; a slice is gone through in such parts, of which hashes and positions stay.
PART = 2 << 20
_WORD_AND_SPACE = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def _ranks(keys: pa.Array) -> np.ndarray:
    """Dense numbers of a slice's keys, in their order."""
    return pc.rank(keys, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _positions(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(documents, their positions as 32-bit integers side by side)."""
    order = np.lexsort((at, doc))
    docs, first = np.unique(doc[order], return_index=True)
    ends = np.append(first, len(order)).astype(np.int32) * 4
    return docs, pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(ends), pa.py_buffer(at[order].astype(np.int32))])


def _words(texts: pa.Array):
    """(first row, words) of the parts of a slice."""
    first = 0
    for part in slices([pa.RecordBatch.from_arrays([texts], ["text"])], "text", PART):
        yield first, Words(part.column(0))
        first += part.num_rows


def _joined(parts: list[tuple], kinds: tuple) -> list[np.ndarray]:
    """The arrays of all parts, one behind the other."""
    return [np.concatenate([np.zeros(0, kind), *column]) for kind, column in zip(kinds, list(zip(*parts)) or [()] * len(kinds))]


def _rows(names: list[str], keys: pa.Array, hashes: list[np.ndarray], doc: np.ndarray, at: np.ndarray, sent: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    """(hashes, key, spots): a row per sent position, and one without hashes per document with known positions."""
    docs, blobs = _positions(doc[known], at[known])
    single = pa.Array.from_buffers(pa.binary(), len(sent), [None, pa.py_buffer(4 * np.arange(len(sent) + 1, dtype=np.int32)), pa.py_buffer(at[sent].astype(np.int32))])
    columns = [pa.concat_arrays([pa.array(h[sent].view(np.int64)), pa.nulls(len(docs), pa.int64())]) for h in hashes]
    columns += [keys.take(pa.array(np.concatenate([doc[sent], docs]))), pa.concat_arrays([single, blobs])]
    return pa.RecordBatch.from_arrays(columns, names)


@releasing
def _anchors(batches):
    long = WIDTH - PERIOD + 1
    for part in slices((b.filter(pc.and_(b.column("key").is_valid(), b.column("copy").is_null())) for b in batches), "text", SLICE):
        keys, found = part.column("key"), []
        for base, words in _words(part.column("text")):
            starts = words.window_starts(long)
            doc = words.owner[starts]
            at = starts - words.start[doc]
            fit = np.isin(at % PERIOD, COVER) & (words.n[doc] >= WIDTH)
            found.append((window_hashes(words.hashes(), starts[fit], long), (base + doc[fit]).astype(np.int32), at[fit].astype(np.int32)))
        h, doc, at = _joined(found, (np.uint64, np.int32, np.int32))
        rank = _ranks(keys)[doc]
        order = np.lexsort((rank, h))
        new = _changes(h[order])
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(order)) - 1 if len(first) else first
        several = (rank[order][first] != rank[order][last])[group] if len(first) else new
        yield _rows(["h", "key", "spots"], keys, [h], doc, at, order[new | ~several], order[several])


@releasing
def _windows(batches):
    for part in slices((b.filter(b.column("spots").is_valid()) for b in batches), "text", SLICE):
        keys, found = part.column("key"), []
        for base, words in _words(part.column("text")):
            step = np.zeros(len(words.owner) + 1, np.int64)
            for i, spots in enumerate(part.column("spots").slice(base, len(words.n)).to_pylist()):  # a window that holds an anchor starts at most v - 1 words before it
                at = np.frombuffer(b"".join(spots), np.int32).astype(np.int64)
                at = at[at < words.n[i]]
                np.add.at(step, words.start[i] + np.maximum(at - (PERIOD - 1), 0), 1)
                np.subtract.at(step, words.start[i] + at + 1, 1)
            starts = words.window_starts(WIDTH)
            starts = starts[np.cumsum(step)[starts] > 0]
            doc = words.owner[starts]
            a, b = (window_hashes(words.hashes(seed), starts, WIDTH, odd) for seed, odd in enumerate(BASES))
            found.append((a, b, (base + doc).astype(np.int32), (starts - words.start[doc]).astype(np.int32)))
        a, b, doc, at = _joined(found, (np.uint64, np.uint64, np.int32, np.int32))
        rank = _ranks(keys)[doc]
        order = np.lexsort((rank, b, a))
        new = _changes(a[order], b[order])
        least = rank[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        cut = rank[order] > least  # another document of this slice has the window under a smaller key
        yield _rows(["h1", "h2", "key", "spots"], keys, [a, b], doc, at, order[~cut], order[cut])


def _per_document(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.collect_list("spots").alias("spots"))


def whole_copies(texts: DataFrame) -> DataFrame:
    """(key, copy): keys whose text, as a whole, also stands under a smaller key."""
    printed = texts.filter("key IS NOT NULL AND text IS NOT NULL").select("key", F.unhex(F.md5("text")).alias("print"))
    least = printed.groupBy("print").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least < most")
    return printed.join(least, "print").filter("key > least").select("key", F.lit(True).alias("copy")).distinct()


def repeated_starts(texts: DataFrame, copies: DataFrame) -> DataFrame:
    """(key, spots) from (key, text, ..): where the windows to be cut start, in words; without `copies` and documents that lose nothing."""
    kind = texts.schema["key"].dataType.simpleString()
    anchors = texts.join(copies, "key", "left").mapInArrow(_anchors, f"h bigint, key {kind}, spots binary")
    # rows of known positions have no hash; a salt of their own keeps them from meeting in one task
    salt = F.xxhash64("key", "spots")
    of = Window.partitionBy(F.coalesce("h", salt), F.col("h").isNull())
    shared = anchors.withColumns({"_lo": F.min("key").over(of), "_hi": F.max("key").over(of)}).filter("h IS NULL OR _lo != _hi")
    windows = texts.join(_per_document(shared), "key", "left").mapInArrow(_windows, f"h1 bigint, h2 bigint, key {kind}, spots binary")
    of = Window.partitionBy(F.coalesce("h1", salt), F.coalesce("h2", F.lit(0)), F.col("h1").isNull())
    return _per_document(windows.withColumn("_lo", F.min("key").over(of)).filter("h1 IS NULL OR _lo != key"))


def _mask(words: Words, spots: list, copies: list) -> np.ndarray:
    """Which of the flat words are covered by a window to be cut."""
    starts = [np.zeros(0, np.int64)]
    for i, (found, copy) in enumerate(zip(spots, copies)):
        if copy:
            starts.append(np.arange(words.start[i], words.start[i + 1] - WIDTH + 1))
        elif found:
            at = np.frombuffer(b"".join(found), np.int32).astype(np.int64)
            starts.append(words.start[i] + at[at + WIDTH <= words.n[i]])
    return covered(len(words.owner), np.concatenate(starts), WIDTH)


def _cleaned(text: str, gone: np.ndarray) -> str:
    """The text without the marked words and the white space behind each of them."""
    raw, out, at = text.encode(), [], 0
    for i, found in enumerate(_WORD_AND_SPACE.finditer(raw)):
        if gone[i]:
            out.append(raw[at:found.start()])
            at = found.end()
    out.append(raw[at:])
    return b"".join(out).decode()


def cut_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", layout: str = "text") -> DataFrame:
    """df with repeated passages cut from its text, and n_words and n_removed, in words.

    layout "text" leaves the remaining text as it was; "words" joins the kept words by one space.
    """
    if layout not in ("text", "words"):
        raise ValueError(f"layout {layout!r}")
    rest = [c for c in df.columns if c not in (key, text, "n_words", "n_removed")]
    laid = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.struct(*rest).alias("rest") if rest else F.lit(0).alias("rest"))
    kind = laid.schema

    @releasing
    def run(batches):
        for part in slices(batches, "text", PART):
            texts, words = part.column("text").to_pylist(), Words(part.column("text"))
            gone = _mask(words, part.column("spots").to_pylist(), part.column("copy").to_pylist())
            lost = np.bincount(words.owner[gone], minlength=len(texts))
            for i, t in enumerate(texts):
                if t is not None and layout == "words":
                    own = t.encode().split()
                    if lost[i]:
                        own = [w for w, g in zip(own, gone[words.start[i]:words.start[i + 1]]) if not g]
                    texts[i] = b" ".join(own).decode()
                elif lost[i]:
                    texts[i] = _cleaned(t, gone[words.start[i]:words.start[i + 1]])
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(texts, pa.string()), part.column("rest"), pa.array(words.n), pa.array(lost.astype(np.int64))],
                                             ["key", "text", "rest", "n_words", "n_removed"])

    schema = T.StructType([*kind.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    copies = whole_copies(laid)
    judged = laid.join(repeated_starts(laid, copies), "key", "left").join(copies, "key", "left")
    out = judged.mapInArrow(run, schema)
    columns = {key: F.col("key"), text: F.col("text"), **{c: F.col("rest").getField(c) for c in rest}}
    return out.select(*[columns[c].alias(c) for c in df.columns if c in columns], "n_words", "n_removed")

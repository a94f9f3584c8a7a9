"""Benchmark decontamination by templates: items are found verbatim and with other numbers, names and units.

Words become canonical tokens: numbers, units and names (capitalised words inside a sentence)
are typed placeholders, everything else its lower-case form without surrounding punctuation.
Windows of canonical tokens are joined by hash between items and documents. Matched windows on
one diagonal (document position minus item position) must fill the slots consistently: one
value of the item stands for one value of the document. Where a number or unit of the item
stands for several, its most frequent one holds, and only the windows that cover another one are
dropped (equal numbers may play independent parts); a name that stands for several is another
text, and drops the diagonal. Windows whose slots hold the item's own values count in any case.
A document leaks an item when at least `share` of the item's windows count.

A template window needs `LITERALS` literal tokens, so placeholders alone never match; an item
shorter than a window is one window of its own length. Beside its template key every window has
an exact key of its real values in lower case, with no literal minimum, and counts where either is
found. The share is taken of the windows with enough literals or of all windows, whichever an item
reaches. Words in capitals throughout, of two letters or more, are words of their own in the exact
key ("US", "us"), so a copy in capitals throughout is not found. A Bloom filter of fixed size over the
item windows drops most document windows before the join; it never drops a match.

Edge cases: null or empty texts and items without a word match nothing; null keys
are not judged; repeated rows count once per key; texts of any length are read whole; an empty
table on either side gives an empty result. Only the named columns are read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, bloom_hit, bloom_words, free_name, pin, releasing, row_name, without_rows
from .words import Words, slices, window_hashes

WIDTH, LITERALS = 8, 4
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
                "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice "
                "first second third fourth fifth sixth seventh eighth ninth tenth").split()
UNITS = ("mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces "
         "ton tons ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks "
         "month months year years meter meters metre metres kilometer kilometers kilometre kilometres mph kph percent % $ € £ ¥ ° degree degrees "
         "dollar dollars cent cents euro euros rupee rupees yen w kw kwh v volt volts watt watts j joule joules hz khz mhz ghz kb mb gb tb").split()
_PUNCTUATION = "!\"#&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„…–—¿¡"
_KINDS = np.array([0, 0x1D3A5F77C2B90E41, 0x5C81B6E3094FD2A7, 0x7E02D94B16A8C35F], np.uint64)  # literal, number, unit, name
_MULTIPLIER = 0x9E3779B97F4A7C15


class Canonical:
    """Canonical tokens of a slice of texts: hash, kind and value per token, and where each text starts."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = pc.replace_substring_regex(texts, r"(\d)(\p{L}|[%°$€£¥])", r"\1 \2")
        texts = pc.replace_substring_regex(texts, r"([$€£¥])(\d)", r"\1 \2")
        words = Words(texts)
        coded = words.flat.dictionary_encode()
        raw, of = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        bare = pc.utf8_trim(raw, characters=_PUNCTUATION)
        low = pc.utf8_lower(bare)

        def flag(mask: pa.Array) -> np.ndarray:
            return mask.to_numpy(zero_copy_only=False).astype(bool)

        number = flag(pc.match_substring_regex(low, r"^\d[\d.,:/]*$")) | flag(pc.is_in(low, pa.array(NUMBER_WORDS, low.type)))
        unit = flag(pc.is_in(low, pa.array(UNITS, low.type))) & ~number
        capital = flag(pc.match_substring_regex(bare, r"^\p{Lu}[\p{L}'’-]+$")) & ~number & ~unit
        closing = flag(pc.match_substring_regex(raw, r"[.!?:;][\"'”’)\]]*$"))
        filled = flag(pc.not_equal(pc.binary_length(low), 0))
        value = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in low.cast(pa.large_binary()).to_pylist()), np.uint64, len(low))
        acronym = flag(pc.match_substring_regex(bare, r"^[\p{Lu}\d'’-]*\p{Lu}[\p{Lu}\d'’-]*\p{Lu}[\p{Lu}\d'’-]*$"))

        opening = np.zeros(len(of), bool)
        opening[1:] = closing[of[:-1]]
        opening[words.start[:-1][words.n > 0]] = True
        kind = np.where(number[of], 1, np.where(unit[of], 2, np.where(capital[of] & ~opening, 3, 0)))
        kept = filled[of]
        self.kind, self.value, self.owner = kind[kept], value[of][kept], words.owner[kept]
        self.hash = np.where(self.kind == 0, self.value, _KINDS[self.kind])
        self.exact = np.where(acronym[of][kept], ~self.value, self.value)
        self.n = np.bincount(self.owner, minlength=len(texts)).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n)])

    def windows(self, width: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the windows with enough literals; the hash tells widths apart."""
        left = self.start[1:][self.owner] - np.arange(len(self.owner))
        starts = np.flatnonzero(left >= width)
        plain = np.concatenate([[0], np.cumsum(self.kind == 0)])
        starts = starts[plain[starts + width] - plain[starts] >= literals]
        return starts, window_hashes(self.hash, starts, width) * np.uint64(_MULTIPLIER) + np.uint64(width)

    def exact_windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of all windows, by their real values; the hashes differ from those of templates."""
        starts = np.flatnonzero(self.start[1:][self.owner] - np.arange(len(self.owner)) >= width)
        return starts, ~(window_hashes(self.exact, starts, width) * np.uint64(_MULTIPLIER) + np.uint64(width))

    def countable(self, starts: np.ndarray, width: int, literals: int) -> np.ndarray:
        plain = np.concatenate([[0], np.cumsum(self.kind == 0)])
        return plain[starts + width] - plain[starts] >= literals

    def slots(self, starts: np.ndarray, width: int) -> pa.Array:
        """The values in each window's placeholders, as lists of hashes; the lowest bit tells names."""
        at = starts[:, None] + np.arange(width)
        taken = self.kind[at] > 0
        ends = np.concatenate([[0], np.cumsum(taken.sum(1))])
        kind = self.kind[at][taken]
        value = (self.value[at][taken] ^ _KINDS[kind]) & ~np.uint64(1) | (kind == 3).astype(np.uint64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value.view(np.int64)))


def _batch(names: list[str], keys: pa.Array, tokens: Canonical, starts: np.ndarray, hashes: np.ndarray, width: int, exact: bool, *more: np.ndarray) -> pa.RecordBatch:
    doc = tokens.owner[starts]
    slots = pa.nulls(len(starts), pa.list_(pa.int64())) if exact else tokens.slots(starts, width)
    columns = [keys.take(pa.array(doc)), pa.array(starts - tokens.start[doc]), pa.array(hashes.view(np.int64)), slots]
    return pa.RecordBatch.from_arrays(columns + [pa.array(m) for m in more], names)


def item_windows(items: DataFrame, key: str, text: str, width: int = WIDTH, literals: int = LITERALS) -> DataFrame:
    """(item, q, h, item_slots, n_windows, n_all, counts, width) of the windows of all items.

    A window has a row by its real values (null slots) and, if it has enough literals (`counts`),
    one by its template. n_windows: windows with enough literals; n_all: all windows.
    """
    names = ["item", "q", "h", "item_slots", "n_windows", "n_all", "counts", "width"]

    @releasing
    def run(batches):
        for part in slices(batches, "text"):
            tokens = Canonical(part.column("text"))
            for w in range(1, width + 1):
                every, exact = tokens.exact_windows(w)
                fit = (tokens.n[tokens.owner[every]] == w) | (w == width)
                every, exact = every[fit], exact[fit]
                starts, hashes = tokens.windows(w, min(literals, w))
                fit = (tokens.n[tokens.owner[starts]] == w) | (w == width)
                starts, hashes = starts[fit], hashes[fit]
                n, n_all = (np.bincount(tokens.owner[x], minlength=part.num_rows).astype(np.int64) for x in (starts, every))
                for at, h, real in ((starts, hashes, False), (every, exact, True)):
                    doc = tokens.owner[at]
                    yield _batch(names, part.column("item"), tokens, at, h, w, real, n[doc], n_all[doc], tokens.countable(at, w, min(literals, w)), np.full(len(at), w, np.int32))

    kind = items.schema[key].dataType.simpleString()
    return (items.filter(F.col(key).isNotNull()).select(F.col(key).alias("item"), F.col(text).alias("text"))
            .mapInArrow(run, f"item {kind}, q bigint, h bigint, item_slots array<bigint>, n_windows bigint, n_all bigint, counts boolean, width int"))


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
          width: int = WIDTH, literals: int = LITERALS, share: float = 0.5) -> DataFrame:
    """(key, item_key, n_windows, n_matched, verbatim): a row per document and item that it leaks.

    verbatim: every slot holds the item's own value. n_windows and n_matched are of the windows
    with enough literals where these reach the share, else of all windows.
    """
    asked = item_windows(items, item_key, item_text, width, literals)
    widths = [r["width"] for r in asked.select("width").distinct().collect()]
    found = bloom_words(asked.select("h").distinct(), "h", hashed=False)

    @releasing
    def run(batches):
        for part in slices(batches, "text"):
            tokens = Canonical(part.column("text"))
            for w in widths:
                for real in (False, True):
                    starts, hashes = tokens.exact_windows(w) if real else tokens.windows(w, min(literals, w))
                    hit = bloom_hit(hashes.view(np.int64), found)
                    yield _batch(["doc", "p", "h", "slots"], part.column("doc"), tokens, starts[hit], hashes[hit], w, real)

    kind = docs.schema[key].dataType.simpleString()
    own = (docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("text"))
           .mapInArrow(run, f"doc {kind}, p bigint, h bigint, slots array<bigint>"))
    # read three times below; few document windows meet an item's
    with arrow_bytes(docs.sparkSession):
        joined = pin(own.join(asked, "h"), "item-hits")
    exact = joined.filter("item_slots IS NULL").select("doc", "item", "n_windows", "n_all", "counts", "q", F.lit(True).alias("verbatim"))
    met = joined.filter("item_slots IS NOT NULL").select("doc", "item", "n_windows", "n_all", "counts", "q", (F.col("p") - F.col("q")).alias("diagonal"), F.arrays_zip("item_slots", "slots").alias("z"))
    # one row per filled slot value, or a single row for a window without slots; partial sums before the shuffle
    filled = met.select("doc", "item", "n_windows", "q", "diagonal", F.explode_outer("z").alias("z"))
    by_value = filled.groupBy("doc", "item", "diagonal", F.col("z.item_slots").alias("item_slots"), F.col("z.slots").alias("slots")).agg(F.count(F.lit(1)).alias("n"))
    by_slot = by_value.groupBy("doc", "item", "diagonal", "item_slots").agg(F.max(F.struct("n", "slots"))["slots"].alias("held"), F.collect_list("slots").alias("seen"))
    # lists of an item's slots at the most: a diagonal has one value per item position
    other = F.transform(F.filter("seen", lambda v: v != F.col("held")), lambda v: F.struct(F.col("item_slots").alias("item_slots"), v.alias("slots")))
    diagonals = by_slot.groupBy("doc", "item", "diagonal").agg(
        F.flatten(F.collect_list(other)).alias("dropped"),
        F.coalesce(F.bool_or((F.size("seen") > 1) & (F.col("item_slots").bitwiseAND(1) == 1)), F.lit(False)).alias("torn"))
    own_values = F.forall("z", lambda x: x["item_slots"] == x["slots"])
    whole = (met.join(diagonals, ["doc", "item", "diagonal"]).withColumn("verbatim", own_values)
             .filter(F.col("verbatim") | (~F.col("torn") & ~F.arrays_overlap("z", "dropped"))))
    either = whole.select(*exact.columns).unionAll(exact)
    once = either.groupBy("doc", "item", "n_windows", "n_all", "counts", "q").agg(F.bool_or("verbatim").alias("verbatim"))
    pairs = once.groupBy("doc", "item", "n_windows", "n_all").agg(
        F.count_if("counts").alias("_n"), F.bool_and("verbatim").alias("_v"), F.coalesce(F.bool_and(F.when(F.col("counts"), F.col("verbatim"))), F.lit(True)).alias("_w"),
        F.count(F.lit(1)).alias("_all"))
    plain = (F.col("_n") > 0) & (F.col("_n") >= F.lit(share) * F.col("n_windows"))
    return (pairs.filter(plain | (F.col("_all") >= F.lit(share) * F.col("n_all")))
            .select(F.col("doc").alias(key), F.col("item").alias(item_key), F.when(plain, F.col("n_windows")).otherwise(F.col("n_all")).alias("n_windows"),
                    F.when(plain, F.col("_n")).otherwise(F.col("_all")).alias("n_matched"), F.when(plain, F.col("_w")).otherwise(F.col("_v")).alias("verbatim")))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without the rows that leak an item. Each row is judged by its own text, also where its key repeats; rows with a null key are not asked and stay."""
    name = free_name(docs, "_row")
    named = docs.withColumn(name, F.when(F.col(key).isNotNull(), row_name(key, text)))
    return without_rows(named, leaks(named, items, key=name, text=text, **how), name).select(*docs.columns)

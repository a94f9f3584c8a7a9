"""Quality rules: per-document rule statistics judged by an isolation forest.

`rule_statistics` counts over whole texts; `base_failed` applies the two fixed rules; an
`IsolationForest` grown on the counts of all rows turns the remaining statistics into an anomaly
score, and its threshold is calibrated on all labelled rows.

Edge cases: a null text counts as empty (0 everywhere, so the base rule rejects it); texts of
any length are read whole, a slice of one row at the least; equal rows get equal results; an
empty table gives an empty result; with no labelled row of either kind the forest rejects
nothing (threshold infinity). Only `key` and `text` are read; any other column is ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_totals
from .common import arrow_bytes, pin, releasing
from .words import Words, covered, slices, window_hashes

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = "[#*$%&|<>]"
REPEAT_WIDTH = 8
MIN_WORDS = 20
#: Features of the forest, as column expressions over the statistics. Repeats are left to the base
#: rule: below its limit they do not tell labelled good from bad rows, and would only add false anomalies.
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
}


def _statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    rows, words = len(texts), Words(texts)
    chars = np.bincount(words.owner, pc.utf8_length(words.flat).to_numpy(zero_copy_only=False), rows).astype(np.int64)

    lists = pc.split_pattern(texts, "\n")
    lines, owner = lists.flatten(), np.repeat(np.arange(rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    seen = np.unique(np.stack([owner[full], codes[full]]), axis=1)
    dup = np.bincount(owner[full], minlength=rows) - np.bincount(seen[0], minlength=rows)

    starts = words.window_starts(REPEAT_WIDTH)
    hashes = window_hashes(words.hashes(), starts, REPEAT_WIDTH)
    of = words.owner[starts]
    order = np.lexsort((hashes, of))
    same = (hashes[order][1:] == hashes[order][:-1]) & (of[order][1:] == of[order][:-1])
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hit = covered(len(words.owner), starts[twice], REPEAT_WIDTH)
    return {"n_words": words.n, "word_chars": chars, "n_symbols": pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64),
            "n_dup_lines": dup.astype(np.int64), "n_repeat_words": np.bincount(words.owner[hit], minlength=rows).astype(np.int64)}


def rule_statistics(df: DataFrame, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, also..., n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row.

    word_chars: code points in words. n_symbols: characters of `#*$%&|<>`. n_dup_lines: lines
    with a word that equal an earlier line. n_repeat_words: words in 8-word windows that occur
    twice or more in the text, the first included.
    """
    @releasing
    def run(batches):
        for part in slices(batches, text):
            found = _statistics(part.column(text))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in (key, *also)] + [pa.array(found[c]) for c in STATISTICS], [key, *also] + STATISTICS)

    shape = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *also)] + [f"{c} bigint" for c in STATISTICS]
    return df.select(key, *also, text).mapInArrow(run, ", ".join(shape))


def base_failed():
    """Too short, or over 30 percent of the words in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass
class IsolationForest:
    """Random split trees as flat arrays of shape (trees, nodes); a leaf has feature -1."""
    feature: np.ndarray
    cut: np.ndarray
    length: np.ndarray
    depth: int
    normal: float

    @staticmethod
    def _expected(n: float) -> float:
        """Mean path length of an unsuccessful search among n points; n may be a fraction."""
        return max(0.0, n - 1) if n <= 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = 200, points: int = 64, seed: int = 7, counts: np.ndarray | None = None) -> IsolationForest:
        """Every tree holds all rows of x (row i stands for counts[i] rows); they weigh as much as `points` points together.

        A node of weight m is cut uniformly between its quantiles 1/(m+1) and m/(m+1), the range that m
        points of it are expected to span, so that one extreme row does not set it; m <= 1 is a leaf.
        """
        rng = np.random.default_rng(seed)
        counts = np.ones(len(x)) if counts is None else counts
        total = counts.sum()
        points = min(points, int(total))
        depth = int(np.ceil(np.log2(max(2, points))))
        size = 2 ** (depth + 1)
        feature, cut, length = np.full((trees, size), -1, np.int32), np.zeros((trees, size)), np.zeros((trees, size))

        def span(values, weights, m):
            order = np.argsort(values)
            upto = np.cumsum(weights[order])
            ends = np.searchsorted(upto, [upto[-1] / (m + 1), upto[-1] * m / (m + 1)])
            return values[order[np.minimum(ends, len(values) - 1)]]

        for t in range(trees):
            todo = [(1, np.arange(len(x)), 0)] if points else []
            while todo:
                node, rows, level = todo.pop()
                m = points * counts[rows].sum() / total
                spans = [span(x[rows, f], counts[rows], m) for f in range(x.shape[1])] if m > 1 and level < depth else []
                wide = [f for f, (low, high) in enumerate(spans) if low < high]
                if not wide:
                    length[t, node] = level + cls._expected(m)
                    continue
                f = rng.choice(wide)
                c = rng.uniform(*spans[f])
                feature[t, node], cut[t, node] = f, c
                todo += [(2 * node, rows[x[rows, f] <= c], level + 1), (2 * node + 1, rows[x[rows, f] > c], level + 1)]
        return cls(feature, cut, length, depth, max(cls._expected(points), 1e-9))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1): near 1 for points that few random splits isolate."""
        total = np.zeros(len(x))
        at = np.arange(len(x))
        for feature, cut, length in zip(self.feature, self.cut, self.length):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, 2 * node + (x[at, np.maximum(f, 0)] > cut[node]), node)
            total += length[node]
        return np.exp2(-total / (len(self.feature) * self.normal))


def with_features(stats: DataFrame) -> DataFrame:
    return stats.withColumns({f"_f_{k}": F.expr(v).cast("double") for k, v in FEATURES.items()})


def with_anomaly(stats: DataFrame, forest: IsolationForest, out: str = "anomaly") -> DataFrame:
    """Statistics with the anomaly score of every row."""
    names, kept = [f"_f_{k}" for k in FEATURES], stats.columns

    @releasing
    def run(batches):
        for b in batches:
            x = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in names], 1)
            score = forest.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(score)], kept + [out])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema)
    return with_features(stats).mapInArrow(run, f"{shape}, {out} double")


def feature_cells(stats: DataFrame, bits: int = 7, most: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
    """(feature values, number of rows) of the cells that the rows of stats fall into; every row is counted.

    A cell holds the rows that agree in the leading `bits` binary digits of each feature behind the first.
    While there are more than `most` cells a digit is dropped, so the driver holds a bounded table.
    """
    names = [f"_f_{k}" for k in FEATURES]

    def rounded(df: DataFrame, digits: int) -> DataFrame:
        step = {n: F.pow(F.lit(2.0), F.floor(F.log2(n)) - digits) for n in names}
        return df.withColumns({n: F.when(F.col(n) > 0, F.floor(F.col(n) / step[n]) * step[n]).otherwise(F.lit(0.0)) for n in names}).groupBy(*names).agg(F.sum("_n").alias("_n"))

    cells = pin(rounded(with_features(stats).withColumn("_n", F.lit(1).cast("bigint")), bits), "rule-cells")
    while bits and cells.count() > most:
        bits -= 1
        cells = pin(rounded(cells, bits), "rule-cells")
    rows = cells.orderBy(*names).select(*names, "_n").toArrow()
    values = [c.to_numpy().astype(float) for c in rows.columns] if rows.num_rows else [np.zeros(0)] * (len(names) + 1)
    return np.stack(values[:-1], 1), values[-1]


def fit_rules(stats: DataFrame, trees: int = 200, points: int = 64) -> IsolationForest:
    """A forest grown on all rows that pass the base rules, by their cells."""
    values, counts = feature_cells(stats.filter(~base_failed()))
    return IsolationForest.fit(values, trees, points, counts=counts)


def good_threshold(scored: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", good_loss: float = 0.002) -> float:
    """The lowest anomaly at which at most `good_loss` of the rows labelled good lie above, over all labelled rows that pass the base rules."""
    marks = labels.filter(F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))
    known = pin(scored.filter(~base_failed()).join(marks, F.col(key) == F.col("_key")).select("_label", "anomaly"), "rule-labelled")
    n = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    if not n.get(1) or not n.get(0):
        return float("inf")
    at = int(np.ceil((n[1] - 1) * (1 - good_loss)))
    totals = running_totals(known.filter("_label = 1"), [], "anomaly", {"_c": F.lit(1).cast("bigint")})
    return totals.filter((F.col("_c_below") <= at) & (F.col("_c_below") + F.col("_c") > at)).first()["anomaly"]


def judge(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = (),
          label: str = "quality", good_loss: float = 0.002, trees: int = 200, points: int = 64) -> DataFrame:
    """One row per row of df: key, the columns of `also`, the statistics, base_failed, anomaly and kept.

    The statistics and the scores are pinned: texts are read once, and fit and verdict see the same numbers.
    """
    with arrow_bytes(df.sparkSession):
        stats = pin(rule_statistics(df, key, text, also), "rules")
        scored = pin(with_anomaly(stats, fit_rules(stats, trees, points)), "rule-scores")
    threshold = good_threshold(scored, labels, key, label, good_loss)
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(threshold)))

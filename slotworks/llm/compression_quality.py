"""Quality by compression: which of two zstandard dictionaries packs a text smaller.

One dictionary is trained on texts labelled good, one on texts labelled bad (with too few samples
for training, the samples themselves are the dictionary). For a text of n bytes that packs into g and b bytes with them, (b - g) / (n + 64) is the normalised difference;
a logistic curve, fitted on labelled rows that no dictionary has seen, makes it a probability.

Samples are bounded by parameters (`rows` texts per label and `bytes_each` bytes of each for the
dictionaries, in pieces spread evenly from the first to the last byte; `calibration` rows for the curve), drawn by the smallest hash of the key; every
text is scored whole. Labels, language, source and key are no inputs of a score.

Edge cases: null and empty texts have difference 0 and get that score; rows with a null key are
scored and count as held out of learning; rows with a null or unknown label, or labelled both
ways, are not learned from; without texts of both labels, every score is the share of good
labels (0.5 without any label). Texts of any length are read whole; repeated rows score alike;
an empty table gives an empty result.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pin
from .words import slices


#: Pieces of a sampled text longer than `bytes_each`.
PIECES = 8


@dataclass
class CompressionClassifier:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    level: int = 3

    def compressors(self) -> tuple:
        if self not in _READY:
            _READY.clear()
            made = []
            for data in (self.good, self.bad):
                known = zstandard.ZstdCompressionDict(data)
                known.precompute_compress(level=self.level)
                made.append(zstandard.ZstdCompressor(level=self.level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
            _READY[self] = tuple(made)
        return _READY[self]

    def __hash__(self):
        return hash((self.good, self.bad, self.level))

    def difference(self, texts: list[str | None]) -> np.ndarray:
        """Bytes that the good dictionary saves against the bad one, per byte of text."""
        good, bad = self.compressors()
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            if t:
                raw = t.encode()
                out[i] = (len(bad.compress(raw)) - len(good.compress(raw))) / (len(raw) + 64)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(texts) + self.offset, -500, 500)))


_READY: dict[CompressionClassifier, tuple] = {}


def dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-6) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic curve, by Newton steps on scaled input."""
    scale = float(np.std(x)) or 1.0
    z = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        grad = z.T @ (p - y) + ridge * w
        hess = (z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z + ridge * np.eye(2)
        w -= np.linalg.solve(hess, grad)
    return float(w[0] / scale), float(w[1])


def spread_pieces(text: str, bytes_each: int) -> Column:
    """Binary pieces of `bytes_each` bytes together, evenly spread over the whole text; a shorter text is one piece."""
    raw, each = F.encode(text, "UTF-8"), max(1, bytes_each // PIECES)
    last = F.octet_length(text) - each
    at = lambda i: F.floor(last.cast("bigint") * i / (PIECES - 1)).cast("int") + 1
    return F.when(F.octet_length(text) <= bytes_each, F.array(raw)).otherwise(F.array(*[F.substring(raw, at(i), F.lit(each)) for i in range(PIECES)]))


def fit(df: DataFrame, labels: DataFrame, learn, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = 1024,
        bytes_each: int = 4096, size: int = 112_640, calibration: int = 8192) -> CompressionClassifier:
    """Build both dictionaries and the curve from labelled rows for which the column expression `learn` holds.

    A third of the labelled keys, by hash, serves the curve only.
    """
    marks = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.min(label).alias("y"), F.max(label).alias("_y")).filter("y = _y")
    # keys first: they are drawn without their texts
    there = df.filter(F.col(key).isNotNull() & learn).groupBy(F.col(key).alias("key")).agg(F.bool_or(F.length(text) > 0).alias("filled"))
    known = pin(there.join(marks.select("key", "y"), "key").withColumn("o", F.xxhash64("key")).withColumn("part", F.pmod("o", F.lit(3))), "labelled")
    ordered = [F.col("o"), F.col("key")]
    first = lambda rows_of, n, use: known.filter(rows_of).orderBy(*ordered).limit(n).select("key", "o", "y", F.lit(use).alias("use"))
    drawn = first("part > 0 AND filled AND y = 1", rows, 1).unionByName(first("part > 0 AND filled AND y = 0", rows, 0)).unionByName(first("part = 0", calibration, 2))
    # 2 * rows + calibration keys at the most, so this side is of bounded size; of rows that repeat a key, one
    sample = pin(df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(pin(drawn, "drawn-keys")), "key")
                 .groupBy("key", "o", "y", "use").agg(F.max("text").alias("text")), "drawn-texts")
    packs = []
    for y in (1, 0):
        # what goes into a dictionary are pieces from all over each sampled text; scores read whole texts
        pieces = sample.filter(F.col("use") == y).orderBy(*ordered).select(spread_pieces("text", bytes_each).alias("pieces"))
        packs.append(dictionary([bytes(p) for r in pieces.collect() for p in r["pieces"]], size))
    model = CompressionClassifier(packs[0], packs[1], 0.0, 0.0)
    if packs[0] and packs[1]:
        def run(batches):
            for part in slices(batches, "text"):
                yield pa.RecordBatch.from_arrays([part.column("y").cast(pa.float64()), pa.array(model.difference(part.column("text").to_pylist()))], ["y", "d"])

        points = sample.filter("use = 2").select("y", "text").mapInArrow(run, "y double, d double").toArrow()
        y, d = (points[c].to_numpy() for c in ("y", "d"))
        if len(set(y.tolist())) == 2:
            model.slope, model.offset = logistic(d, y)
            return model
    share = known.agg(F.avg("y")).first()[0]
    share = min(max(0.5 if share is None else share, 1e-3), 1 - 1e-3)
    return CompressionClassifier(packs[0] or b"\0", packs[1] or b"\0", 0.0, float(np.log(share / (1 - share))))


def score(df: DataFrame, model: CompressionClassifier, key: str = "doc_id", text: str = "text", out: str = "score") -> DataFrame:
    """(key, score) of every row, from its whole text."""
    def run(batches):
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(model.score(part.column("text").to_pylist()))], ["key", out])

    kind = df.schema[key].dataType.simpleString()
    return (df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, {out} double")
            .withColumnRenamed("key", key))

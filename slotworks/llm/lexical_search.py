"""Ranked lexical search: accumulator-limited term-at-a-time over an index of document slices.

1. `build_index` turns every slice of input into a row: keys and lengths of its documents, and for
   each term that a query asks for the documents that hold it, with its occurrences. The rows are
   written once; the numbers of documents and occurrences of all slices are summed from them.
2. Each task goes through its slices. For every query it takes the terms rarest first and adds their
   parts to accumulators, one per document. Once the largest parts that the remaining terms can
   still give are together less than the k-th best partial score, no document without an
   accumulator can come among the k best, so none is created any more; those that exist are
   updated to their exact scores. The k-th score that a task has reached carries over to its next
   slice. A slice gives k rows per query at the most.
3. The best k rows per query are taken from those of all tasks, in two steps.

Queries are a stated set; they are taken in blocks of `block` queries, whose terms and weights are
sent to the tasks, so that what is sent is bounded. Scores are whole numbers:
    w = floor(1000 * ln((2 N + 2) / (2 df + 1)))
    m = 100 - share + share * n * N div L
    score = sum of w * (10**9 * tf div (1000 * tf + 8 * m))

Edge cases: documents with a null text or without a term are no documents of the collection and
never found; queries without a term or with a null key find nothing; rows that repeat a query's key
are one query with all their terms; rows that repeat a document's key are documents of their own;
a null document key comes last among equal scores; equal scores go to the smaller key; texts of
any length are read whole; an empty table on either side gives an empty result. Other columns are
not read.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import pin, with_global_rank
from .runs import terms
from .words import slices

TOP, SHARE, BLOCK = 10, 90, 2048
SLICE = 16 << 20
GROUPS = 64


@dataclass
class Queries:
    """A block of queries: distinct terms, and for each query the positions of its terms."""
    keys: list
    terms: pa.Array
    of: list[np.ndarray]


def query_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term), distinct: the terms of every query."""
    def run(batches):
        for part in slices(batches, "text"):
            words = terms(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(words.owner)), words.flat.cast(pa.string())], ["item", "term"])

    kind = items.schema[key].dataType.simpleString()
    return (items.filter(F.col(key).isNotNull()).select(F.col(key).alias("item"), F.col(text).alias("text"))
            .mapInArrow(run, f"item {kind}, term string").distinct())


def query_blocks(asked: DataFrame, block: int) -> list[DataFrame]:
    """The queries in blocks of `block`, by the order of their keys."""
    ranked, total = with_global_rank(asked.select("item").distinct(), ["item"], "at")
    if total <= block:
        return [asked]
    return [asked.join(ranked.filter(F.col("at").between(at, at + block - 1)).select("item"), "item") for at in range(0, total, block)]


def collected(asked: DataFrame) -> Queries:
    """One block on the driver: `block` queries and their terms."""
    rows = asked.orderBy("item", "term").toArrow()
    items, words = rows["item"].combine_chunks(), rows["term"].combine_chunks().dictionary_encode()
    keys = items.dictionary_encode()
    owner, term = (x.indices.to_numpy(zero_copy_only=False) for x in (keys, words))
    cuts = np.flatnonzero(np.diff(owner)) + 1
    return Queries(keys.dictionary.to_pylist(), words.dictionary.cast(pa.large_string()), np.split(term.astype(np.int64), cuts) if len(term) else [])


def build_index(docs: DataFrame, known: pa.Array, key: str, text: str) -> DataFrame:
    """A row per slice: keys and lengths of its documents with terms, and the postings of the known terms.

    terms: the known terms of the slice; ends: where the postings of each end; spot and tf: documents
    (as positions in `doc`) and occurrences, by term.
    """
    names = ["doc", "length", "terms", "ends", "spot", "tf"]

    def run(batches):
        for part in slices(batches, "text", SLICE):
            words = terms(part.column("text"))
            there = np.flatnonzero(words.n)
            if not len(there):
                continue
            place = np.zeros(len(words.n), np.int64)
            place[there] = np.arange(len(there))
            coded = words.flat.dictionary_encode()
            number = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
            hit = number >= 0
            both, tf = np.unique(number[hit].astype(np.int64) << 32 | place[words.owner[hit]], return_counts=True)
            term = both >> 32
            first = np.flatnonzero(np.diff(term, prepend=-1))
            values = [part.column("doc").take(pa.array(there)), words.n[there], term[first].astype(np.int32),
                      np.append(first[1:], len(term))[:len(first)].astype(np.int32), (both & 0xFFFFFFFF).astype(np.int32), tf.astype(np.int32)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v)) for v in values]
            yield pa.RecordBatch.from_arrays(lists, names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(
        run, f"doc array<{kind}>, length array<bigint>, terms array<int>, ends array<int>, spot array<int>, tf array<int>")


def collection(index: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents, occurrences of all terms, documents per known term) from all slices."""
    total = index.agg(F.sum(F.size("doc")).alias("n"), F.sum(F.aggregate("length", F.lit(0).cast("bigint"), lambda s, v: s + v)).alias("l")).first()
    part = F.explode(F.transform("terms", lambda t, i: F.struct(t.alias("t"), (F.get("ends", i) - F.when(i > 0, F.get("ends", i - 1)).otherwise(0)).alias("n"))))
    df = np.zeros(n_terms, np.int64)
    counted = index.select(part.alias("p")).groupBy("p.t").agg(F.sum("p.n").cast("bigint").alias("n")).toArrow()
    df[counted["t"].to_numpy()] = counted["n"].to_numpy()
    return total["n"] or 0, total["l"] or 0, df


def weights(df: np.ndarray, total: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * total + 2) / (2 * df + 1))).astype(np.int64)


class Slice:
    """Postings of one slice, with the part that each adds to a score, and the largest part per term."""

    def __init__(self, row: dict, weight: np.ndarray, total: int, occurrences: int, share: int):
        self.size = len(row["length"])
        m = 100 - share + (share * row["length"] * total) // occurrences
        self.ends, self.spot = row["ends"].astype(np.int64), row["spot"]
        self.place = np.full(len(weight), -1, np.int64)
        self.place[row["terms"]] = np.arange(len(row["terms"]))
        n = np.diff(self.ends, prepend=0)
        tf = row["tf"].astype(np.int64)
        self.part = np.repeat(weight[row["terms"]], n) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.spot]))
        self.most = np.maximum.reduceat(self.part, self.ends - n) if len(n) else np.zeros(0, np.int64)

    def best(self, query: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, exact scores) of at least all documents that can be among the k best, given that k documents elsewhere reach `floor`.

        `query` holds terms, rarest first.
        """
        at = self.place[query]
        at = at[at >= 0]
        left = np.append(np.cumsum(self.most[at][::-1])[::-1], 0)  # what the terms from here on can add
        score, made = np.zeros(self.size, np.int64), np.zeros(self.size, bool)
        creating, kth = True, floor
        for step, t in enumerate(at.tolist()):
            spot = self.spot[self.ends[t - 1] if t else 0:self.ends[t]]
            part = self.part[self.ends[t - 1] if t else 0:self.ends[t]]
            if creating and left[step] < kth:
                creating = False
            if creating:
                score[spot] += part
                made[spot] = True
                # a k-th partial score matters only where the rest could fall below it
                if left[step + 1] and step + 1 < len(at) and left[step + 1] <= score.max():
                    full = score[made]
                    if len(full) >= k:
                        kth = max(floor, int(np.partition(full, len(full) - k)[len(full) - k]))
            else:
                old = made[spot]
                score[spot[old]] += part[old]
        found = np.flatnonzero(made & (score > 0) & (score >= floor))
        return found, score[found]


def search_block(index: DataFrame, asked: Queries, item_type: T.DataType, k: int, share: int) -> DataFrame:
    """(item, doc, score, grp): up to k rows per query and task that hold the best k of all documents."""
    total, occurrences, df = collection(index, len(asked.terms))
    weight = weights(df, total)
    # rarest first; equal ones by position
    ordered = [q[np.lexsort((q, df[q]))] for q in asked.of]
    keys = asked.keys

    def run(batches):
        floor = np.zeros(len(ordered), np.int64)
        held: list[list] = [[] for _ in ordered]
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].values for c in batch.schema.names}
                doc = row.pop("doc")
                part = Slice({c: v.to_numpy(zero_copy_only=False) for c, v in row.items()}, weight, total, occurrences, share)
                for i, query in enumerate(ordered):
                    spots, scores = part.best(query, k, int(floor[i]))
                    if len(spots):
                        known = doc.take(pa.array(spots)).to_pylist()
                        held[i] += zip((-scores).tolist(), ((d is None, d) for d in known))
                        held[i].sort()
                        del held[i][k:]
                        if len(held[i]) == k:
                            floor[i] = -held[i][-1][0]
        group = TaskContext.get().partitionId() % GROUPS
        rows = [(keys[i], d, -s, group) for i, best in enumerate(held) for s, (_, d) in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], ["item", "doc", "score", "grp"])

    schema = T.StructType([T.StructField("item", item_type), T.StructField("doc", index.schema["doc"].dataType.elementType),
                           T.StructField("score", T.LongType()), T.StructField("grp", T.IntegerType())])
    types = to_arrow_schema(schema).types
    return index.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
           k: int = TOP, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """(item_key, rank, key, score): the k best documents of every query, rank 1 first."""
    asked = pin(query_terms(items, item_key, item_text), "query-terms")
    out = None
    for part in query_blocks(asked, block):
        queries = collected(part)
        index = pin(build_index(docs, queries.terms, key, text), "index")
        found = search_block(index, queries, items.schema[item_key].dataType, k, share)
        out = found if out is None else out.unionByName(found)
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    # a query's rows grow with the tasks, so they are cut per group of tasks first
    near = out.withColumn("r", F.row_number().over(Window.partitionBy("item", "grp").orderBy(*order))).filter(F.col("r") <= k)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return best.select(F.col("item").alias(item_key), "rank", F.col("doc").alias(key), "score")

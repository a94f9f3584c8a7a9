"""Incremental twins of three batch behaviours: resume, merge and progress."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalars as S
from ..operators.bank import expect_same_identity, pending_ids
from ..operators.checks import require_clean


Done = Callable[[SparkSession, int], DataFrame | None]
Sink = Callable[[DataFrame, int], None]


def extract_batch(batch: DataFrame, batch_id: int, done: Done, encode: Callable[[DataFrame], DataFrame], sink: Sink, identity: str) -> None:
    """Encode the studies of one batch that no other batch has finished.

    A batch may be replayed after a crash. `done` must therefore leave out the
    rows that this batch id wrote itself, and `sink` must replace them: then a
    replay repeats the same work instead of overwriting it with nothing.
    """
    finished = done(batch.sparkSession, batch_id)
    todo = batch
    if finished is not None:
        require_clean(expect_same_identity(finished, identity))
        todo = batch.join(pending_ids(batch, finished, identity), "study_id", "left_semi")
    sink(encode(todo), batch_id)


def incremental_extract(arrivals: DataFrame, done: Done, encode: Callable[[DataFrame], DataFrame], sink: Sink, identity: str, checkpoint: str):
    """Encode studies as they arrive; finished ones are skipped, another identity fails.

    arrivals is a stream with study_id, done(spark, batch_id) gives the rows
    (study_id, identity) finished by other batches or None, sink(rows, batch_id)
    replaces the output of a batch id. Returns the started query; it stops when
    the available input is used up.
    """
    each = lambda batch, batch_id: extract_batch(batch, batch_id, done, encode, sink, identity)
    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MERGE_OUT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("study_id", T.StringType()),
                          T.StructField("slot", T.IntegerType()), T.StructField("n_slots", T.IntegerType())])
MERGE_STATE = T.StructType([T.StructField("seen", T.LongType()), T.StructField("want", T.LongType()), T.StructField("last", T.LongType())])


def _merge_rows(study, slot: np.ndarray, mask: np.ndarray, seen: int) -> tuple[pd.DataFrame, int]:
    """(events of some arrivals in their order, slots seen after them)."""
    bit = np.int64(1) << slot
    planned = (mask & bit) != 0
    again = pd.Series(np.where(planned, slot, -1)).duplicated().to_numpy() | ((np.int64(seen) & bit) != 0)
    new = planned & ~again
    after = np.bitwise_or.accumulate(np.where(new, bit, 0)) | np.int64(seen)
    full = new & (after == mask)
    kind = np.select([~planned, again, full], ["unexpected", "duplicate", "complete"], "")
    told = kind != ""
    out = pd.DataFrame({"kind": kind, "study_id": study, "slot": np.where(full, -1, slot).astype(np.int32),
                        "n_slots": np.where(full, np.bitwise_count(after), 0).astype(np.int32)})
    return out[told], int(after[-1])


def streaming_merge(arrivals: DataFrame, ts: str | None = None, late: str = "1 hour", linger: str = "1 hour") -> DataFrame:
    """(kind, study_id, slot, n_slots) from a stream (study_id, slot, planned_mask).

    'complete' once per study when its slots equal the planned bit mask,
    'duplicate' for a slot that came before, 'unexpected' for a slot outside the
    plan. State per study is two integers, whatever the row count; embeddings
    never enter it. A complete study keeps its mask so that late duplicates are
    still rejected.

    With `ts`, an event time, a study's state is released: once the watermark (the
    latest event less `late`) has passed its last event by `linger`, the state goes,
    and a study that is not complete by then gives one row 'incomplete' with the
    number of its slots (slot -1). Rows behind the watermark are dropped, so what
    comes after that opens no new state. Without `ts` state is kept for ever.
    """
    spark = arrivals.sparkSession
    stay = 0 if ts is None else int(spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {linger}) AS ms").first()["ms"])

    def merge(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, want, last = state.get if state.exists else (0, 0, 0)
        if state.hasTimedOut:
            state.remove()
            if seen != want:
                yield pd.DataFrame({"kind": ["incomplete"], "study_id": [key[0]], "slot": np.int32([-1]), "n_slots": np.int32([seen.bit_count()])})
            return
        for pdf in batches:
            if len(pdf):
                mask = pdf["planned_mask"].to_numpy(np.int64)
                out, seen = _merge_rows(key[0], pdf["slot"].to_numpy(np.int64), mask, seen)
                want = int(mask[-1])
                if ts is not None:
                    last = max(last, int(pdf["_ms"].max()))
                yield out
        state.update((seen, want, last))
        if ts is not None:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + stay + 1)

    if ts is None:
        return arrivals.groupBy("study_id").applyInPandasWithState(merge, MERGE_OUT, MERGE_STATE, "append", GroupStateTimeout.NoTimeout)
    timed = arrivals.withWatermark(ts, late).withColumn("_ms", F.unix_millis(ts))
    return timed.groupBy("study_id").applyInPandasWithState(merge, MERGE_OUT, MERGE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def progress_rates(receipts: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Images, seconds and images/s per window. Works on a batch or a stream; a
    zoneless event time counts as UTC (watermarks need a zoned type).

    Sums combine map-side before the shuffle, so a busy window is no hot task.
    """
    zoneless = receipts.schema[ts].dataType.typeName() == "timestamp_ntz"
    timed = receipts.withColumn(ts, F.timestamp_micros(S.utc_micros(ts))) if zoneless else receipts
    if receipts.isStreaming:
        timed = timed.withWatermark(ts, late)
    out = timed.groupBy(F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("steps"), F.sum("images").alias("images"), F.sum("seconds").alias("seconds"))
    return out.select(F.col("w.start").alias("start"), "steps", "images", "seconds",
                      F.try_divide(F.col("images").cast("double"), F.col("seconds").cast("double")).alias("images_per_second"))

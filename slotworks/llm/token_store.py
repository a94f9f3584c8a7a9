"""Token ids in binary shards with a perfect-hash index.

Layout of a store folder:

* `shard-<k>.ids`: the ids of the shard's documents side by side, as 16- or 32-bit integers,
  little-endian; documents in ascending key order within and across shards.
* `shard-<k>.rows`: 64-bit integers, where each document's ids start, counted in ids, and the end.
* `index-<b>.mph`: for the keys of one hash bucket a minimal perfect hash and, per slot, the key's
  fingerprint, its first row in the store and its number of rows. A lookup computes the bucket,
  one slot, and compares the fingerprint.
* the table `shards`: number, rows and ids of each shard.

Every file is written under a name of its own attempt and then moved into place, so a task that
runs again puts the same bytes in the same place. Files go through pyarrow's file systems, so the
folder can be in any store that these reach from the executors.

Edge cases: a null text is an empty one and holds the end id only; rows with a null key are one
key, the first in order; rows that repeat a key are next to each other, also across shards, and
all are found; a key that is not in the store gives no row (or, once in 2**32, is taken for
another one: its fingerprint is compared, not the key). Texts of any length are read whole; an
empty table gives an empty store. Keys are integers; other columns are not stored.
"""
from __future__ import annotations

import gc
import json
import os
import uuid
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .byte_bpe import Pieces
from .common import arrow_bytes, pin, shared_dir
from .perfect_hash import PerfectHash
from .words import slices

BUCKET_KEYS = 1 << 16
#: Bytes of text that are cut into pieces together; of more text, more pieces are repeats.
SLICE = 8 << 20
#: Pieces that the library encodes side by side; its time per byte grows with the length of a text.
GROUP = 64
_MAGIC = 0x4D50484958303031


class LibraryCodec:
    """Encoding with the tokenizers library: each distinct piece of a slice goes through it once."""

    def __init__(self, path: str, kept: int = 1 << 19):
        self.path, self.kept = path, kept

    def pieces(self) -> Pieces:
        if self.path not in _CODECS:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            known = Tokenizer.from_file(self.path)
            known.encode_special_tokens = True  # their strings in a text are ordinary text
            kind = json.loads(known.pre_tokenizer.__getstate__()) if known.pre_tokenizer else {}
            # where the ends of pre-tokens are known, pieces are finer than stretches between spaces
            fine = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and known.normalizer is None

            vocabulary = known.get_vocab()
            size = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id: a byte is a character of the token's name
            for token, i in vocabulary.items():
                size[i] = len(token)

            def resolve(parts: list[str]) -> list[bytes]:
                # pieces that begin with white space and end without are encoded side by side, and the ids are told apart by their bytes
                out = [b""] * len(parts)
                plain = [i for i, p in enumerate(parts) if len(p) > 1 and p[0] in " \n" and not p[1].isspace() and not p[-1].isspace()]
                side = [parts[i] for i in plain]
                found = known.encode_batch_fast(["".join(side[at:at + GROUP]) for at in range(0, len(side), GROUP)], add_special_tokens=False)
                ids = np.fromiter(chain.from_iterable([e.ids for e in found]), np.int32)
                ends, want = np.cumsum(size[ids]), np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in side], dtype=np.int64)
                stop = np.searchsorted(ends, want, side="left") + 1
                if len(ends) != (stop[-1] if len(stop) else 0) or not np.array_equal(ends[stop - 1], want):
                    raise ValueError("a token spans two pieces")
                data, at = ids.tobytes(), 0
                for i, b in zip(plain, (4 * stop).tolist()):
                    out[i], at = data[at:b], b
                rest = sorted(set(range(len(parts))).difference(plain))
                for i, e in zip(rest, known.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False)):
                    out[i] = np.array(e.ids, np.int32).tobytes()
                return out

            _CODECS[self.path] = Pieces(resolve, lambda text: [text], self.kept, fine=fine)
        return _CODECS[self.path]

    def width(self) -> int:
        """Bytes of an id."""
        return 2 if Tokenizer.from_file(self.path).get_vocab_size() <= 1 << 16 else 4


_CODECS: dict[str, Pieces] = {}


@dataclass
class TokenStore:
    folder: str
    width: int
    buckets: int
    shards: list[tuple[int, int, int]]  # number, first row, first id; one entry per shard file


def _files(folder: str):
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _moved(system, path: str, write) -> None:
    attempt = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(attempt) as out:
        write(out)
    try:
        system.move(attempt, path)
    except OSError:  # a store that does not replace files: another attempt has put the same bytes there
        if system.get_file_info(path).type != fs.FileType.File:
            raise
        system.delete_file(attempt)


def _key_bytes(keys: pd.Series) -> list[bytes]:
    return [b"" if pd.isna(k) else int(k).to_bytes(8, "little", signed=True) for k in keys.tolist()]


def write(df: DataFrame, codec: LibraryCodec, key: str = "doc_id", text: str = "text", end_id: int = 0, bucket_keys: int = BUCKET_KEYS) -> TokenStore:
    """Encode every text, append `end_id`, and write shards in ascending key order and their index."""
    spark = df.sparkSession
    folder, width = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}", codec.width()
    if folder.startswith("file:/") and not folder.startswith("file:///"):
        folder = "file://" + folder[5:]
    kind = "<u2" if width == 2 else "<u4"
    system, root = _files(folder)
    system.create_dir(root, recursive=True)

    def run(batches):
        part = TaskContext.get().partitionId()
        system, root = _files(folder)
        pieces, ends, keys = codec.pieces(), [np.zeros(1, np.int64)], []

        def ids(out):
            total = 0
            for chunk in slices(batches, "text", SLICE):
                gc.disable()
                found, stop = pieces.encode(chunk.column("text"))
                gc.enable()
                with_end = np.insert(found, stop, end_id).astype(kind)
                out.write(with_end.tobytes())
                ends.append(total + stop + np.arange(1, len(stop) + 1))
                total = int(ends[-1][-1])
                keys.append(chunk.column("key"))

        _moved(system, f"{root}/shard-{part}.ids", ids)
        stops = np.concatenate(ends)
        _moved(system, f"{root}/shard-{part}.rows", lambda out: out.write(stops.astype("<i8").tobytes()))
        row = 0
        for k in keys:
            n = len(k)
            yield pa.RecordBatch.from_arrays([k, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), pa.array(np.diff(stops[row:row + n + 1]))], ["key", "shard", "row", "n"])
            row += n

    # ranges also split a key that many rows repeat
    laid = (df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
            .repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text"))
    with arrow_bytes(spark, SLICE):  # a batch is a slice
        rows = pin(laid.mapInArrow(run, "key bigint, shard int, row bigint, n bigint"), "token-rows")
    shards, first_row, first_id = [], 0, 0
    for r in sorted(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("ids")).collect()):
        shards.append((r["shard"], first_row, first_id))
        first_row, first_id = first_row + r["rows"], first_id + r["ids"]
    spark.createDataFrame(shards, "shard int, first_row bigint, first_id bigint").coalesce(1).write.parquet(f"{folder}/shards")

    starts = np.zeros(max([s[0] for s in shards], default=0) + 1, np.int64)
    for s in shards:
        starts[s[0]] = s[1]
    at = F.get(F.from_json(F.lit(str(starts.tolist())), "array<bigint>"), F.col("shard")) + F.col("row")
    entries = rows.withColumn("at", at).groupBy("key").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    buckets = max(1, -(-first_row // bucket_keys))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        halves = PerfectHash.halves(_key_bytes(pdf["key"]))
        found = PerfectHash.build(halves)
        order = np.argsort(found.slots(halves))
        head = np.array([_MAGIC, found.n, len(found.pilots)], "<i8").tobytes()
        data = [head, found.pilots.astype("<i8").tobytes(), (halves[1][order] >> np.uint64(32)).astype("<u4").tobytes(),
                pdf["at"].to_numpy()[order].astype("<i8").tobytes(), pdf["n"].to_numpy()[order].astype("<i8").tobytes()]
        system, root = _files(folder)
        _moved(system, f"{root}/index-{bucket}.mph", lambda out: out.write(b"".join(data)))
        return pd.DataFrame({"bucket": [bucket], "n": [found.n]})

    bucketed = entries.withColumn("bucket", _bucket(buckets))
    bucketed.groupBy("bucket").applyInPandas(build, "bucket int, n bigint").write.format("noop").mode("overwrite").save()
    return TokenStore(folder, width, buckets, shards)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit(""))), F.lit(buckets)).cast("int")


def _load_index(folder: str, bucket: int):
    system, root = _files(folder)
    if system.get_file_info(f"{root}/index-{bucket}.mph").type == fs.FileType.NotFound:
        return None
    with system.open_input_file(f"{root}/index-{bucket}.mph") as f:
        raw = f.read()
    magic, n, m = np.frombuffer(raw, "<i8", 3)
    if magic != _MAGIC:
        raise ValueError(f"index-{bucket}.mph is no index")
    at = 24
    out = []
    for kind, count in (("<i8", m), ("<u4", n), ("<i8", n), ("<i8", n)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    return PerfectHash(out[0], int(n)), *out[1:]


def locate(store: TokenStore, keys: DataFrame) -> DataFrame:
    """(key, shard, row) of every stored row of the given distinct keys, through the index."""
    numbers = np.array([s[0] for s in store.shards], np.int64)
    firsts = np.array([s[1] for s in store.shards], np.int64)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        index = _load_index(store.folder, int(pdf["bucket"].iloc[0]))
        if index is None:
            return pd.DataFrame({"key": [], "shard": [], "row": []})
        perfect, prints, at, n = index
        halves = PerfectHash.halves(_key_bytes(pdf["key"]))
        slot = perfect.slots(halves)
        known = prints[slot] == (halves[1] >> np.uint64(32)).astype(np.uint32)
        slot = slot[known]
        many = n[slot]
        row = np.repeat(at[slot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        place = np.searchsorted(firsts, row, side="right") - 1
        keys = pdf["key"][known].to_numpy()
        return pd.DataFrame({"key": pd.array(np.repeat(keys, many), dtype="Int64"), "shard": numbers[place].astype(np.int32), "row": row - firsts[place]})

    return keys.withColumn("bucket", _bucket(store.buckets)).groupBy("bucket").applyInPandas(run, "key bigint, shard int, row bigint")


def read(store: TokenStore, spark: SparkSession, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, ids) of the given keys: start counts the ids of all rows before; ids are 32-bit integers, little-endian, end id included."""
    first_id = {s[0]: s[2] for s in store.shards}
    kind = "<u2" if store.width == 2 else "<u4"

    def run(batches):
        system, root = _files(store.folder)
        shard, stops, payload = None, None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                start, ids = [], []
                for s, row in zip(part.column("shard").to_pylist(), part.column("row").to_pylist()):
                    if s != shard:
                        shard = s
                        with system.open_input_file(f"{root}/shard-{s}.rows") as f:
                            stops = np.frombuffer(f.read(), "<i8")
                        payload = system.open_input_file(f"{root}/shard-{s}.ids")
                    a, b = int(stops[row]), int(stops[row + 1])
                    start.append(first_id[s] + a)
                    ids.append(np.frombuffer(payload.read_at((b - a) * store.width, a * store.width), kind).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], ["key", "start", "ids"])

    placed = locate(store, keys.select(F.col(key).cast("bigint").alias("key")).distinct())
    # shards are dealt in pieces, so that a large one is read by several tasks
    ordered = placed.repartition("shard", F.shiftright("row", 14)).sortWithinPartitions("shard", "row")
    return ordered.mapInArrow(run, "key bigint, start bigint, ids binary").withColumnRenamed("key", key)

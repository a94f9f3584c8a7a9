"""Byte-level BPE over a rank file: two-tier encoding of whole texts, and decoding.

A pre-token that is a vocabulary entry is found by a minimal perfect hash and a comparison
with the entry in its slot. Any other one is merged over linked bytes with a heap, lowest rank
first and leftmost among equal ranks. Distinct stretches of text are coded once per slice, and
their ids are kept in a table of bounded size per worker.

Edge cases: a null text is encoded as an empty one (no ids); texts of any length are read
whole; null ids decode to empty bytes, an unknown id raises; repeated rows are encoded alike;
an empty table gives an empty result. Other columns are passed through; the out column
replaces one of the same name.
"""
from __future__ import annotations

import base64
import gc
from array import array
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import releasing
from .perfect_hash import PerfectHash
from .words import slices

#: A space between two characters that are not white space begins a pre-token, so texts without
#: any other white space next to a space can be cut at spaces before the pattern is applied.
_WHITE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
_ODD_SPACE = rf"{_WHITE} | {_WHITE}|\A | \z"


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank by token bytes, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


#: Of bytes: ASCII letters, ASCII punctuation, ASCII characters that can be seen.
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_MARK = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])
_SEEN = np.array([32 < b < 127 for b in range(256)])


def _finely(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(pieces of all texts, pieces of each text), without copying a text; see `Pieces`."""
    texts = pa.concat_arrays([texts, texts.slice(0, 0)])
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[:ends[-1]] if len(texts) else np.zeros(0, np.uint8)
    begins = np.ones(len(raw) + 1, bool)
    if len(raw):
        one, two = raw[:-1], raw[1:]
        letter = _LETTER[one]
        # U+00C0 to U+00FF are letters but for the signs of times and division
        letter[1:] |= (one[:-1] == 0xC3) & (one[1:] != 0x97) & (one[1:] != 0xB7)
        begins[1:-1] = (two == 0x20) | (letter & _MARK[two]) | ((two == 0x0A) & _SEEN[one])
        begins[ends] = True
    at = np.flatnonzero(begins)
    n = np.diff(np.searchsorted(at, ends))
    cut = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), data]) if len(raw) else pa.array([], pa.large_string())
    return cut.dictionary_encode(), n


class Pieces:
    """Ids of whole texts from ids of their pieces, of which up to about `kept` are remembered between slices.

    `resolve` gives the ids of pieces as 32-bit integers side by side. A piece ends where a
    pre-token ends: at a single space, or, around other white space, where `split` says so.
    Texts are cut in Arrow, and only the distinct pieces of a slice become Python strings. With `fine`,
    a piece also ends where a letter meets ASCII punctuation and before a line feed, which are ends of
    pre-tokens in PATTERN; so words with and without punctuation are one piece.
    """

    def __init__(self, resolve, split, kept: int, by_spaces: bool = True, fine: bool = False):
        self.resolve, self.split, self.kept, self.by_spaces, self.fine = resolve, split, kept, by_spaces, fine
        self.seen: dict[str, bytes] = {}

    def cut(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct pieces, piece of each occurrence, number of pieces of each text)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False).astype(bool)
        filled = pc.not_equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(bool)
        even = filled & ~odd if self.by_spaces else np.zeros(len(texts), bool)
        if self.fine:
            coded, n = _finely(texts.filter(pa.array(even)))
            distinct, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
            return self._with_rest(texts, distinct, code, n, even, filled)
        lists = pc.split_pattern(texts.filter(pa.array(even)), " ")
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pa.concat_arrays([lists.flatten()]).dictionary_encode()
        # behind a text's first piece, each begins with the space that was cut away
        code = 2 * coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        code[np.cumsum(n) - n] -= 1
        used = np.zeros(2 * len(coded.dictionary), bool)
        used[code] = True
        there, code = np.flatnonzero(used), (np.cumsum(used, dtype=np.int32) - 1)[code]
        names = coded.dictionary.take(pa.array(there >> 1)).to_numpy(zero_copy_only=False).tolist()
        distinct = [" " + p if spaced else p for p, spaced in zip(names, (there & 1).tolist())]
        return self._with_rest(texts, distinct, code, n, even, filled)

    def _with_rest(self, texts: pa.Array, distinct: list[str], code: np.ndarray, n: np.ndarray, even: np.ndarray, filled: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """With the pieces of the texts that are not `even`, which `split` cuts."""
        counts = np.zeros(len(texts), np.int64)
        counts[even] = n
        rest = np.flatnonzero(filled & ~even)
        if not len(rest):
            return distinct, code, counts
        number = {p: i for i, p in enumerate(distinct)}
        pieces = [[number.setdefault(p, len(number)) for p in self.split(t)] for t in texts.take(pa.array(rest)).to_pylist()]
        counts[rest] = [len(p) for p in pieces]
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]), np.int64)
        out[np.repeat(even, counts)] = code
        out[np.repeat(filled & ~even, counts)] = np.array([p for x in pieces for p in x], np.int64)
        return list(number), out, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text ends)."""
        distinct, code, counts = self.cut(texts)
        found = [*map(self.seen.get, distinct)]
        missed = [i for i, ids in enumerate(found) if ids is None]
        new = [distinct[i] for i in missed]
        for i, p, ids in zip(missed, new, self.resolve(new)):
            found[i] = self.seen[p] = ids
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
        ids = lists.take(pa.array(code)).flatten().to_numpy(zero_copy_only=False) if len(code) else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(size[code])])
        for part in [p for p in new if len(p) > 256]:
            del self.seen[part]
        if len(self.seen) > self.kept:  # the older half goes
            self.seen = dict(islice(self.seen.items(), len(self.seen) - self.kept // 2, None))
        return ids, ends[np.cumsum(counts)]


class Codec:
    """Encoder and decoder of one rank file.

    Built on the driver; what is sent to tasks is the path and the perfect hash. A worker process
    reads the file once and keeps its tables, also between tasks.
    """

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, kept: int = 1 << 18, by_spaces: bool = True):
        self.key = (path, pattern, kept, by_spaces)
        self.pilots = PerfectHash.build(PerfectHash.halves(list(read_ranks(path)))).pilots

    @property
    def tables(self) -> Tables:
        if self.key not in _TABLES:
            _TABLES[self.key] = Tables(*self.key, self.pilots)
        return _TABLES[self.key]


class Tables:
    """What encoding and decoding look up. `kept` bounds the pre-tokens remembered between slices."""

    def __init__(self, path: str, pattern: str, kept: int, by_spaces: bool, pilots: np.ndarray):
        self.ranks = read_ranks(path)
        self.hash = PerfectHash(pilots, len(self.ranks))
        tokens = list(self.ranks)
        self.slots: list[bytes] = [b""] * len(tokens)
        for slot, token in zip(self.hash.slots(PerfectHash.halves(tokens)).tolist(), tokens):
            self.slots[slot] = token
        self.slot_ids = [self.ranks[t].to_bytes(4, "little") for t in self.slots]
        by_id: list[bytes | None] = [None] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            by_id[i] = token
        self.by_id = pa.array(by_id, pa.large_binary())
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        # rank of two neighbouring parts, by their ids; of two neighbouring bytes, -1 where there is none
        self.pairs: list[dict[int, int]] = [{} for _ in by_id]
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                if t[:i] in self.ranks and t[i:] in self.ranks:
                    self.pairs[self.ranks[t[:i]]][self.ranks[t[i:]]] = r
        self.byte_pairs = [[self.pairs[a].get(b, -1) for b in self.byte_ids] for a in self.byte_ids]
        self.split = regex.compile(pattern).findall
        self.pieces = Pieces(self.resolve, self.split, kept, by_spaces)

    def merge(self, piece: bytes) -> bytes:
        """Ids of one pre-token, as 32-bit integers side by side: a heap of rank and position over linked parts."""
        n, pairs = len(piece), self.pairs
        ids = [*map(self.byte_ids.__getitem__, piece)]
        rank = [ranks[b] for ranks, b in zip(map(self.byte_pairs.__getitem__, piece), piece[1:])]  # of the part and the next one
        rank.append(-1)
        bits = n.bit_length()
        heap, low = [r << bits | i for i, r in enumerate(rank) if r >= 0], (1 << bits) - 1
        heapify(heap)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while heap:
            top = heappop(heap)
            i, r = top & low, top >> bits
            if rank[i] != r:
                continue  # one of the two parts has changed since
            gone = after[i]
            ids[i], rank[gone], k = r, -1, after[gone]
            ids[gone] = -1
            after[i] = k
            if k < n:
                before[k] = i
                if (b := ids[k]) in (known := pairs[r]):
                    rank[i] = new = known[b]
                    heappush(heap, new << bits | i)
                else:
                    rank[i] = -1
            else:
                rank[i] = -1
            j = before[i]
            if j >= 0:
                if r in (known := pairs[ids[j]]):
                    rank[j] = new = known[r]
                    heappush(heap, new << bits | j)
                else:
                    rank[j] = -1
        return array("i", [x for x in ids if x >= 0]).tobytes()

    def resolve(self, parts: list[str]) -> list[bytes]:
        """Ids of stretches of text, each ending where a pre-token ends."""
        words = [self.split(p) for p in parts]
        new = list({w for group in words for w in group})
        raw = [w.encode() for w in new]
        slots = self.hash.slots(PerfectHash.halves(raw)).tolist() if raw else []
        ids = dict(zip(new, [self.slot_ids[s] if self.slots[s] == b else self.merge(b) for b, s in zip(raw, slots)]))
        return [ids[group[0]] if len(group) == 1 else b"".join(map(ids.__getitem__, group)) for group in words]

    def decode(self, ids: pa.Array, offsets: np.ndarray) -> pa.Array:
        """Bytes per list of ids, as Arrow binaries: the entries of the vocabulary side by side."""
        taken = self.by_id.take(ids)
        if taken.null_count:
            raise ValueError("an id is not in the vocabulary")
        taken = pa.concat_arrays([taken])
        _, ends, data = taken.buffers()
        at = np.frombuffer(ends, np.int64)[taken.offset:][offsets] if len(taken) else np.zeros(len(offsets), np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(at.astype(np.int64)), data or pa.py_buffer(b"")]).cast(pa.binary())


_TABLES: dict[tuple, Tables] = {}


def _replaced(df: DataFrame, out: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    kept = [c for c in df.columns if c != out]
    return kept, T.StructType([df.schema[c] for c in kept] + [T.StructField(out, kind)])


def encode(df: DataFrame, codec: Codec, text: str = "text", out: str = "ids", drop_text: bool = True) -> DataFrame:
    """df with `out`, an array of ids, in place of the text (or beside it)."""
    kept, schema = _replaced(df.drop(text) if drop_text else df, out, T.ArrayType(T.IntegerType(), False))

    @releasing
    def run(batches):
        tables = codec.tables
        for part in slices(batches, text):
            gc.disable()  # many small objects without cycles
            ids, ends = tables.pieces.encode(part.column(text))
            gc.enable()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [lists], kept + [out])
        # the worker may go on with other stages, which need the memory
        tables.pieces.seen = {}

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, codec: Codec, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """df with `out`, the bytes that the ids stand for."""
    kept, schema = _replaced(df, out, T.BinaryType())

    @releasing
    def run(batches):
        tables = codec.tables
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part.column(ids)
                offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
                found = tables.decode(lists.flatten(), offsets)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [found], kept + [out])

    return df.mapInArrow(run, schema)

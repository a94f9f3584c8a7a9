"""Words of whole texts as flat numpy arrays, used inside Arrow tasks.

A word is a run of bytes other than 0x20 and 0x09-0x0D. `Words` holds the words of
many texts in one flat array: text k has the words start[k] .. start[k+1].
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
#: Odd multipliers of the rolling hashes; fixed, so that every task gives equal windows equal keys.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def slices(batches, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a slice holds `most` bytes of text, or a single longer row.

    A slice is a copy of its rows, as pyarrow's ascii_lower misreads sliced arrays. Null texts stay null.
    """
    for batch in batches:
        at = batch.schema.get_field_index(text)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        ends, first, total = np.cumsum(sizes), 0, 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, total + most, side="right")))
            part = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c, c.slice(0, 0)]) for c in part.columns], schema=part.schema)
            first, total = last, int(ends[last - 1])


class Words:
    """Flat words of an Arrow text column."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary()).cast(pa.large_string())
        if lower:
            texts = pc.ascii_lower(pa.concat_arrays([texts, texts.slice(0, 0)]))
        lists = pc.ascii_split_whitespace(texts)
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        flat, lens = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(lens)), lens)[full]
        self.flat = flat.filter(pa.array(full)) if not full.all() else flat
        self.n = np.bincount(owner, minlength=len(lens)).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n)]).astype(np.int64)
        self.owner = owner.astype(np.int64)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash per word, computed once per distinct word of the slice."""
        if not len(self.flat):
            return np.zeros(0, np.uint64)
        coded = self.flat.dictionary_encode()
        if not hasattr(self, "_distinct"):
            self._coded = coded.indices.to_numpy(zero_copy_only=False)
            self._distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
        table = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self._distinct), np.uint64, len(self._distinct))
        return table[self._coded]

    def window_starts(self, width: int) -> np.ndarray:
        """Flat positions at which a window of `width` words fits into its text."""
        left = self.start[1:][self.owner] - np.arange(len(self.owner))
        return np.flatnonzero(left >= width)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(16, (n + 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            out.append(np.multiply.accumulate(step))
        _powers[base] = have = (out[0], out[1])
    return have


def window_hashes(values: np.ndarray, starts: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """Rolling polynomial hash of `width` word hashes from each start, the same wherever the window stands."""
    forth, back = powers(base, len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * forth[: len(values)], out=prefix[1:])
    h = (prefix[starts + width] - prefix[starts]) * back[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n positions lie in a window of `width` from one of the starts."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.subtract.at(step, np.minimum(starts + width, n), 1)
    return np.cumsum(step[:n]) > 0

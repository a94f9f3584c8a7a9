"""Texts with all bytes outside a character class blanked, so that the class's maximal runs are words of `Words`."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import Words

_SPACE = 0x20


def _letters(of) -> np.ndarray:
    """Byte table: what `of` maps a byte to, 0 for a byte that ends a run."""
    return np.array([of(b) for b in range(256)], np.uint8)


def _lower(b: int) -> int:
    return b + 32 if 0x41 <= b <= 0x5A else b


#: Digits, ASCII letters and everything beyond ASCII; A-Z lower-cased.
TERM_BYTES = _letters(lambda b: _lower(b) if b >= 0x80 or chr(b).isalnum() else _SPACE)
_LATIN_BYTES = _letters(lambda b: _lower(b) if b < 0x80 and chr(b).isalpha() else _SPACE)


def _rebuilt(texts: pa.Array, change) -> pa.Array:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts]) if isinstance(texts, pa.Array) else texts.combine_chunks()
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((ends - ends[0]).astype(np.int64)), pa.py_buffer(change(raw))])


def terms(texts: pa.Array) -> Words:
    """Maximal runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return Words(_rebuilt(texts, lambda raw: TERM_BYTES[raw]))


def latin_runs(texts: pa.Array) -> Words:
    """Maximal runs `[A-Za-z\\u00C0-\\u00FF]+`, A-Z lower-cased: ASCII letters, and 0xC3 with the byte behind it."""
    def change(raw):
        lead = raw == 0xC3
        lead[1:] |= raw[:-1] == 0xC3
        return np.where(lead, raw, _LATIN_BYTES[raw])

    return Words(_rebuilt(texts, change))

"""Words of Arrow text batches as numpy arrays: spans, 64-bit word hashes and window hashes, without a Python loop over words.

Texts stay UTF-8 bytes. All word classes here are made of ASCII separators, so a byte test equals the test by
character. Hashes only find candidates or group equal windows; callers compare the words where a collision would matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step handles at most (one longer text is a step of its own).
STEP_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 4096
_R_BYTE = np.uint64(0x9E3779B97F4A7C15)
_R_WORD = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_POW_BYTE = _powers(_R_BYTE, _BLOCK)
_R_INVERSE = tuple(np.uint64(pow(int(r), -1, 2**64)) for r in _R_WORD)


def byte_class(separators: bytes) -> np.ndarray:
    """True for each byte that belongs to words."""
    out = np.ones(256, dtype=bool)
    out[np.frombuffer(separators, dtype=np.uint8)] = False
    return out


#: [^\x20\x09-\x0D]
NOT_SPACE = byte_class(b" \t\n\v\f\r")
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], met after A-Z became a-z
ALPHANUMERIC = byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A finishing step that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of some rows of a batch. rows: their range; first[i]: the first word of row i, first[-1]: the number of words; bounds: bytes where rows begin and end."""

    rows: range
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        n = len(self.starts)
        out = np.zeros(n, dtype=np.uint64)
        lengths = self.ends - self.starts
        ends = np.cumsum(lengths)
        at = 0
        while at < n:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_BYTES, side="right")))
            ln = lengths[at:stop]
            begins = np.cumsum(ln) - ln
            place = np.arange(int(ln.sum())) - np.repeat(begins, ln)
            value = _BYTE[self.data[place + np.repeat(self.starts[at:stop], ln)]] * _POW_BYTE[place % _BLOCK]
            if ln.max(initial=0) > _BLOCK:
                value *= (place // _BLOCK * 2 + 1).astype(np.uint64)
            out[at:stop] = np.add.reduceat(value, begins)
            at = stop
        return mix(out + (lengths.astype(np.uint64) << np.uint64(56)))

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, joined by one space."""
        raw = self.data
        return b" ".join(raw[s:e].tobytes() for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True))

    def room(self, n: int) -> np.ndarray:
        """For each word, whether n words of its own row start there."""
        counts = np.diff(self.first)
        left = np.repeat(self.first[1:], counts) - np.arange(len(self.starts))
        return left >= n


def prefix(h: np.ndarray, which: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * _powers(_R_WORD[which], len(h)), out=out[1:])
        return out


def windows(sums: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of the n words from each place on, whatever stands around them. sums: prefix() of the word hashes."""
    m = len(sums) - 1 - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return mix((sums[n:] - sums[:m]) * _powers(_R_INVERSE[which], m) + np.uint64(n))


def window_hash(h: np.ndarray, which: int = 0) -> int:
    return int(windows(prefix(h, which), len(h), which)[0])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    else:
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_steps(column: pa.Array, kind: np.ndarray = NOT_SPACE, lower: bool = False) -> Iterator[Words]:
    """Words of a text column, in steps of whole rows."""
    if not len(column):
        return
    all_bytes, offsets = text_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        stop = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, side="right")) - 1))
        data = all_bytes[offsets[at] : offsets[stop]]
        if lower:
            data = _LOWER[data]
        bounds = offsets[at : stop + 1] - offsets[at]
        inside = kind[data]
        size = len(data)
        before, after = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = bounds[1:-1]
        before[cuts[cuts < size]] = False
        after[cuts[cuts > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        yield Words(range(at, stop), data, starts, ends, np.searchsorted(starts, bounds), bounds)
        at = stop

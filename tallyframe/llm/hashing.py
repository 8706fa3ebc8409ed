"""Word hashes and shingle sets of whole texts, many documents at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # texts are worked on in slices of about this size; a longer text is a slice of its own
BLOCK_BYTES = 1 << 18  # bytes hashed at once, cut between words

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD_FACTORS = np.array(
    [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB],
    dtype=np.uint64,
)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits so that equal values, and only they, stay equal."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for base in (_BASE, inverse):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers.append(table)
        del _powers[:-2]
    return _powers[0], _powers[1]


def spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges [start, end) and the number of the range of each."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.arange(sizes.sum()) - first + starts[owner], owner


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in runs whose texts are about ``SLICE_BYTES`` long together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_hashes(texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of each text, and the word offsets of the texts.

    Words are runs without the six ASCII blanks; with ``fold`` A-Z count as a-z.
    """
    data, offsets = text_bytes(texts)
    found, starts = [], []
    at, end = 0, len(data)
    while at < end:
        stop = min(end, at + BLOCK_BYTES)
        if stop < end:  # go on to the next blank or the next text
            next_text = offsets[np.searchsorted(offsets, stop)]
            while stop < next_text:
                blanks = np.flatnonzero(_BLANK[data[stop : min(next_text, stop + 4096)]])
                if len(blanks):
                    stop += int(blanks[0])
                    break
                stop = min(int(next_text), stop + 4096)
        block = data[at:stop]
        if fold:
            block = _FOLD[block]
        n = len(block)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets[(offsets >= at) & (offsets <= stop)] - at] = True
        edge[0] = edge[n] = True
        blank = _BLANK[block]
        word = ~blank
        before, after = edge[:-1].copy(), edge[1:].copy()
        before[1:] |= blank[:-1]
        after[:-1] |= blank[1:]
        first = np.flatnonzero(word & before)
        last = np.flatnonzero(word & after) + 1
        power, inverse = _power_tables(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        found.append(mix((total[last] - total[first]) * inverse[first]))
        starts.append(first + at)
        at = stop
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    begin = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return hashes, np.searchsorted(begin, offsets).astype(np.int64)


def shingles(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word windows and their offsets; a shorter text is one window, an empty one none."""
    counts = np.diff(offsets)
    if len(hashes) >= 5:
        windows = hashes[:-4] * _WORD_FACTORS[0]
        for k in range(1, 5):
            windows += hashes[k : len(hashes) - 4 + k] * _WORD_FACTORS[k]
        windows = mix(windows)
    else:
        windows = np.zeros(0, np.uint64)
    made = np.where(counts >= 5, counts - 4, (counts > 0).astype(np.int64))
    ends = np.concatenate(([0], np.cumsum(made)))
    out = np.empty(ends[-1], dtype=np.uint64)
    for row in range(len(counts)):
        n, start = counts[row], offsets[row]
        if n >= 5:
            out[ends[row] : ends[row + 1]] = windows[start : start + n - 4]
        elif n:
            own = hashes[start : start + n] * _WORD_FACTORS[:n]
            out[ends[row]] = mix(np.array([own.sum(dtype=np.uint64) + np.uint64(n)], dtype=np.uint64))[0]
    return out, ends


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted set of shingle hashes of every text."""
    windows, ends = shingles(*word_hashes(texts))
    return [np.unique(windows[a:b]) for a, b in zip(ends[:-1], ends[1:])]

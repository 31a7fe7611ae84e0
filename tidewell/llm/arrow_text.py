"""Vectorised text work on Arrow columns inside Spark tasks.

Texts are read as UTF-8 bytes, so that words, n-grams and their 64-bit hashes of many rows
come from a few array operations. All functions are pure and keep no state between batches.
A word's identity is its 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(inside: bytes, value: int, table: np.ndarray) -> np.ndarray:
    table[np.frombuffer(inside, np.uint8)] = value
    return table


#: Byte -> folded byte: A-Z to a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Byte classes; 0 separates. Bytes of multi-byte characters are always inside words.
SPACED = _table(b"\x20\x09\x0a\x0b\x0c\x0d", 0, np.ones(256, np.uint8))
ALNUM = _table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), 0, np.ones(256, np.uint8))
WORD_PUNCT = _table(bytes(range(0x21, 0x7F)), 2, np.zeros(256, np.uint8))
WORD_PUNCT[ALNUM == 1] = 1
WORD_PUNCT[ord("_")] = 1

_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT)) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, base in (("up", _MULT), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row offsets in them; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, offsets


def slices(column: pa.Array, most_bytes: int = SLICE_BYTES, most_rows: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of row ranges of bounded size; one row at least."""
    if not len(column):
        return
    raw, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        fits = int(np.searchsorted(offsets, offsets[row] + most_bytes, side="right")) - 1
        stop = min(max(row + 1, fits), row + most_rows, rows)
        yield row, stop, raw[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def runs(raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte start and end of each run of one non-zero class; no run crosses a row."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = classes[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    inside = kind[at[:-1]] != 0
    return at[:-1][inside], at[1:][inside]


def run_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run [start, end), in blocks of bounded memory. Starts must ascend."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + SLICE_BYTES)))
        low, high = int(start[i]), int(end[i:j].max())
        up, down = _powers(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[raw[low:high]] * up[: high - low], out=sums[1:])
        a, b = start[i:j] - low, end[i:j] - low
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct hashes of each row's k-word shingles, A-Z folded, and the row offsets in them.

    Rows of fewer than k words, but not none, have their whole word sequence as one element.
    """
    folded = FOLD[raw]
    start, end = runs(folded, offsets, SPACED)
    words = run_hashes(folded, start, end)
    first = np.searchsorted(start, offsets)
    counts = np.diff(first)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    out_at = np.concatenate(([0], np.cumsum(made)))
    out = np.empty(int(out_at[-1]), np.uint64)
    long_row = np.repeat(counts >= k, made)
    n = len(words)
    if n >= k:
        grams = words[: n - k + 1].copy()
        for j in range(1, k):
            grams *= np.uint64(_MULT)
            grams += words[j : n - k + 1 + j]
        row_end = np.repeat(first[1:], counts)
        inside = np.arange(n - k + 1) + k <= row_end[: n - k + 1]
        out[long_row] = mix(grams[inside])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        h = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            use = counts[short] > j
            h[use] = h[use] * np.uint64(_MULT) + words[first[short[use]] + j]
        out[~long_row] = mix(h ^ (counts[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    for r in np.flatnonzero(made > 1):
        out[out_at[r] : out_at[r + 1]].sort()
    keep = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    keep[out_at[:-1][made > 0]] = True
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[out_at]


def long_view(values: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's signed bigint."""
    return values.view(np.int64)

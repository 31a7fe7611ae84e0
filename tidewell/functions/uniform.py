"""Reproducible randomness: numbers that depend on a seed and a row's key alone, never on partitions."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def uniform(seed: int, *keys: Column) -> Column:
    """In [0, 1): the first 8 hex digits of md5('seed:key:...') over 2^32."""
    return F.conv(F.substring(_digest(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


#: P(X <= k) of a Poisson variable of mean 1, k = 0..11.
POISSON_STEPS = tuple(sum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1)) for k in range(12))


def once(x: Column) -> Column:
    """x as a generated column: later uses read it instead of working it out again (select or withColumn only)."""
    return F.explode(F.array(x))


def poisson(u: Column) -> Column:
    """The Poisson(1) quantile of a uniform number: a bootstrap multiplicity."""
    return sum(((u >= step).cast("int") for step in POISSON_STEPS[1:]), (u >= POISSON_STEPS[0]).cast("int"))


def poisson_counts(seed: int, key: Column, n: int, first: int = 1) -> Column:
    """An array of poisson(uniform(seed, key, i)) for i = first..n, read off the digests' texts: u >= step if the hex digits are not below the step's own."""
    steps = [format(math.ceil(step * 4294967296.0), "08x") for step in POISSON_STEPS]

    def count(digest: Column) -> Column:
        out = F.when(digest < steps[0], 0)
        for k, step in enumerate(steps[1:], 1):
            out = out.when(digest < step, k)
        return out.otherwise(len(steps))

    return F.transform(F.transform(F.sequence(F.lit(first), F.lit(n)), lambda i: _digest(seed, key, i)), count)


#: MD5's constants, shifts and first state.
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of text that fit into one MD5 block, and rows whose state stays in a CPU's cache.
_BLOCK, _ROWS = 55, 8192


def _first_words(words: dict[int, np.ndarray | int], rows: int) -> np.ndarray:
    """The first 8 hex digits, as numbers, of the MD5 of one-block messages. words: of 16, those that are not 0; arrays, or a number for all rows."""
    a, b, c, d = (np.full(rows, x, np.uint32) for x in _STATE)
    f, g = np.empty(rows, np.uint32), np.empty(rows, np.uint32)
    for i in range(64):
        turn = i // 16
        if turn == 0:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = words.get((i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16, 0)
        constant = _SINES[i]
        if isinstance(word, np.ndarray):
            np.add(a, word, out=a)
        else:
            constant += word
        np.add(a, f, out=a), np.add(a, np.uint32(constant & 0xFFFFFFFF), out=a)
        shift = _SHIFTS[turn][i % 4]
        np.left_shift(a, np.uint32(shift), out=g), np.right_shift(a, np.uint32(32 - shift), out=a), np.bitwise_or(a, g, out=a), np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return (a + np.uint32(_STATE[0])).byteswap()


def drawn(prefixes: np.ndarray, n: int, first: int = 1):
    """Yields (places, counts): poisson_counts of first..n as a matrix, for some of the rows at a time. prefixes: bytes 'seed:key:', without their NULs at the end."""
    steps = [np.uint32(x) for x in (math.ceil(step * 4294967296.0) for step in POISSON_STEPS) if x < 2**32]  # no hash reaches 2^32
    lengths = np.char.str_len(prefixes)
    for length in np.unique(lengths):
        same = np.flatnonzero(lengths == length)
        for places in np.array_split(same, -(-len(same) // _ROWS)):
            counts = np.zeros((n - first + 1, len(places)), np.uint8)
            base = None
            if length + len(str(n)) <= _BLOCK:
                base = np.ascontiguousarray(np.zeros((len(places), 64), np.uint8))
                base[:, :length] = prefixes[places].astype(f"S{length}").view(np.uint8).reshape(len(places), length)
                base = np.ascontiguousarray(base.view("<u4").T)
            for r in range(first, n + 1):
                if base is None:
                    u = np.array([int.from_bytes(hashlib.md5(x + str(r).encode()).digest()[:4], "big") for x in prefixes[places]], np.uint32)
                else:
                    text = bytes(length) + str(r).encode()
                    tail = np.frombuffer((text + b"\x80").ljust(56, b"\0") + (8 * len(text)).to_bytes(8, "little"), "<u4")
                    whole = -(-int(length) // 4)
                    u = _first_words({j: base[j] + tail[j] if j < whole else int(tail[j]) for j in range(16)}, len(places))
                for step in steps:
                    counts[r - first] += u >= step
            yield places, counts

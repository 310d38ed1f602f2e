"""Spark's and Java's random generators, for draws that have to come out as those of Spark's own learners.

``XorShift`` is the generator of Spark's samplers. A step is linear over bits, so it can be jumped ahead of: a task draws the
numbers of any rows of a partition without those before them."""

from __future__ import annotations

import math

import numpy as np

_M32, _M64 = (1 << 32) - 1, (1 << 64) - 1


def _signed(x: int, bits: int) -> int:
    return x - (1 << bits) if x >> (bits - 1) else x


def _murmur3(data: bytes, h: int) -> int:
    """32-bit MurmurHash3 of whole 4-byte words."""
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & _M32
        k = (k << 15 | k >> 17) * 0x1B873593 & _M32
        h ^= k
        h = ((h << 13 | h >> 19) & _M32) * 5 + 0xE6546B64 & _M32
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & _M32
    h = (h ^ h >> 13) * 0xC2B2AE35 & _M32
    return h ^ h >> 16


def first_state(seed: int) -> int:
    """The state that a seed (a long) starts ``XorShift`` at."""
    data = (seed & _M64).to_bytes(8, "big")
    low = _murmur3(data, 0x3C074A61)
    return _murmur3(data, low) << 32 | low


class XorShift:
    def __init__(self, seed: int):
        self.state = first_state(seed)

    def _next(self, bits: int) -> int:
        s = self.state
        s ^= s << 21 & _M64
        s ^= s >> 35
        self.state = s = s ^ s << 4 & _M64
        return s & (1 << bits) - 1

    def next_int(self) -> int:
        return _signed(self._next(32), 32)

    def next_double(self) -> float:
        return ((self._next(26) << 27) + self._next(27)) * 2.0 ** -53


class JavaRandom:
    """``java.util.Random``, which Scala's ``Random`` is too."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & (1 << 48) - 1

    def _next(self, bits: int) -> int:
        self.state = self.state * 0x5DEECE66D + 0xB & (1 << 48) - 1
        return _signed(self.state >> 48 - bits, bits)

    def next_int(self, bound: int | None = None) -> int:
        if bound is None:
            return self._next(32)
        u = self._next(31) & (1 << 31) - 1
        if bound & -bound == bound:
            return bound * u >> 31
        while u - u % bound + bound - 1 >= 1 << 31:
            u = self._next(31) & (1 << 31) - 1
        return u % bound

    def next_long(self) -> int:
        return _signed((self._next(32) << 32) + self._next(32) & _M64, 64)

    def next_double(self) -> float:
        return (((self._next(26) & (1 << 26) - 1) << 27) + (self._next(27) & (1 << 27) - 1)) * 2.0 ** -53


# ------------------------------------------------------------ jumps of XorShift
def _step(s: np.ndarray) -> np.ndarray:
    s = s ^ s << np.uint64(21)
    s ^= s >> np.uint64(35)
    return s ^ s << np.uint64(4)


def _apply(table: np.ndarray, s: np.ndarray) -> np.ndarray:
    out = np.zeros_like(s)
    for i in range(8):
        out ^= table[i][(s >> np.uint64(8 * i) & np.uint64(255)).astype(np.intp)]
    return out


def _table(columns: np.ndarray) -> np.ndarray:
    """The linear map with the given images of the 64 bits, as one table of 256 entries per byte."""
    out = np.zeros((8, 256), np.uint64)
    for bit in range(64):
        i, b = divmod(bit, 8)
        out[i] ^= np.where(np.arange(256) >> b & 1, columns[bit], np.uint64(0))
    return out


class _Jumps:
    tables: list[np.ndarray] = []  # of 1, 2, 4, .. steps

    @classmethod
    def get(cls, i: int) -> np.ndarray:
        bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
        while len(cls.tables) <= i:
            cls.tables.append(_table(_apply(cls.tables[-1], _apply(cls.tables[-1], bits)) if cls.tables else _step(bits)))
        return cls.tables[i]


def jump(state: np.ndarray, steps: np.ndarray | int) -> np.ndarray:
    """The states ``steps`` steps (fewer than 2^63, one number for each) after ``state``."""
    state, steps = np.broadcast_arrays(np.asarray(state, np.uint64), np.asarray(steps, np.int64))
    state = state.copy()
    for i in range(int(steps.max(initial=0)).bit_length()):
        here = (steps >> i & 1).astype(bool)
        if here.any():
            state[here] = _apply(_Jumps.get(i), state[here])
    return state


LANE = 64  # numbers (a power of 2) that are drawn one after the other; the lanes of a block are drawn side by side


def doubles(seeds: list[int], start: int, n: int) -> np.ndarray:
    """``next_double`` of generators with these seeds, numbers ``start`` .. ``start + n - 1``: one row per seed."""
    lanes = -(-n // LANE)
    s = jump(np.array([first_state(s) for s in seeds], np.uint64), 2 * start)[:, None]
    while s.shape[1] < lanes:  # as many lanes again, each as far ahead as there are lanes
        s = np.concatenate((s, _apply(_Jumps.get((2 * LANE * s.shape[1]).bit_length() - 1), s)), axis=1)
    s = s[:, :lanes]
    out = np.empty((LANE, len(seeds), lanes))
    for i in range(LANE):
        s = _step(s)
        high = s & np.uint64((1 << 26) - 1)
        s = _step(s)
        out[i] = ((high << np.uint64(27)) + (s & np.uint64((1 << 27) - 1))) * 2.0 ** -53
    return out.transpose(1, 2, 0).reshape(len(seeds), lanes * LANE)[:, :n]


def take_one(sizes: list[int], seed: int) -> tuple[int, int]:
    """Partition and place in it of the row that ``RDD.takeSample(False, 1, seed)`` returns, by the partitions' numbers of rows:
    rows are skipped by geometric gaps at a rate that a sample is hardly ever empty at, and one of those met is drawn."""
    total = sum(sizes)
    rand = JavaRandom(seed)
    if total == 1:
        return next(p for p, n in enumerate(sizes) if n), 0
    gamma = -math.log(1e-4) / total
    fraction = min(1.0, max(1e-10, 1 / total + gamma + math.sqrt(gamma * gamma + 2 * gamma / total)))
    while True:
        met, seeds = [], JavaRandom(rand.next_int())
        for p, n in enumerate(sizes):
            rng = XorShift(seeds.next_long())
            if fraction >= 1.0:
                met += [(p, i) for i in range(n)]
            elif fraction > 0.4:
                met += [(p, i) for i in range(n) if rng.next_double() <= fraction]
            else:
                lnq, at = math.log1p(-fraction), 0
                while (at := at + int(math.log(max(rng.next_double(), 5e-11)) / lnq)) < n:
                    met.append((p, at))
                    at += 1
        if met:
            break
    for i in range(len(met) - 1, 0, -1):
        j = rand.next_int(i + 1)
        met[i], met[j] = met[j], met[i]
    return met[0]

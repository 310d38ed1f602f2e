"""Byte-level helpers of the operators that read texts inside tasks: bounded pieces, packed arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

SPACES = b" \t\n\x0b\x0c\r"  # what bytes.split() cuts at: the contracts' separators of words


def pieces(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``raw`` cut before a separator (a byte of ``SPACES``) into parts of ``size`` bytes or little more, so that the words
    of a very long text need not be in memory together. A word longer than ``size`` stays whole."""
    start, n = 0, len(raw)
    while n - start > size:
        end = start + size
        found = -1
        while found < 0 and end < n:  # the next separator of any kind, looked for block by block
            block = raw[end:end + 4096]
            at = [i for i in map(block.find, (SPACES[k:k + 1] for k in range(len(SPACES)))) if i >= 0]
            found = end + min(at) if at else -1
            end += 4096
        if found < 0:
            break
        yield raw[start:found]
        start = found
    yield raw[start:] if start else raw


def packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpacked(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(blob)), dtype)

"""Columns of numbers packed into one binary value, for rows that carry many small records."""

from __future__ import annotations

import struct

import numpy as np


def pack(*columns: np.ndarray) -> bytes:
    """Byte planes of each column, compressed together; equal lengths are assumed."""
    import zstandard

    head = struct.pack("<QB", len(columns[0]), len(columns)) + b"".join(c.dtype.str.encode().ljust(4) for c in columns)
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns)
    return head + zstandard.ZstdCompressor(level=1).compress(planes)


def rows_in(data: bytes) -> int:
    return struct.unpack_from("<Q", data)[0]


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    n, k = struct.unpack_from("<QB", data)
    kinds = [np.dtype(data[9 + 4 * i : 13 + 4 * i].decode().strip()) for i in range(k)]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9 + 4 * k :]), np.uint8) if n else np.zeros(0, np.uint8)
    out, at = [], 0
    for kind in kinds:
        size = n * kind.itemsize
        out.append(planes[at : at + size].reshape(kind.itemsize, n).T.copy().view(kind).reshape(n))
        at += size
    return out


def unpack_all(blobs: list[bytes]) -> list[np.ndarray]:
    """The columns of several values, one behind the other."""
    return [np.concatenate(c) for c in zip(*map(unpack, blobs), strict=True)]

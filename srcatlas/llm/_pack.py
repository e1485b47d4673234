"""Arrays of numbers as compressed blobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def packed(x: np.ndarray) -> bytes:
    """Numbers by their bytes' places, compressed: leading zeros cost nothing."""
    x = np.ascontiguousarray(x).reshape(-1)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(blob[8:], n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)


def ascending(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences."""
    return packed(np.diff(x, prepend=np.uint64(0)))


def ascended(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, np.uint64), dtype=np.uint64)


def cuts(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, from, to) of each run of sorted keys."""
    at = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    return ((int(keys[a]), a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if b > a)

"""The BLAKE3 hash, from its published specification: plainly for one content, by NumPy lanes for many."""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the specification: initial state, message permutation, flags.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
BLOCK, CHUNK, MASK = 64, 1024, 0xFFFFFFFF

_SCHEDULES = [tuple(range(16))]
for _ in range(6):
    _SCHEDULES.append(tuple(_SCHEDULES[-1][p] for p in PERMUTATION))
#: The columns and diagonals that one round mixes.
_QUARTERS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _compress(cv: tuple[int, ...], block: bytes, counter: int, length: int, flags: int) -> list[int]:
    m = struct.unpack("<16I", block.ljust(BLOCK, b"\0"))
    v = [*cv, *IV[:4], counter & MASK, counter >> 32, length, flags]
    for order in _SCHEDULES:
        for q, (a, b, c, d) in enumerate(_QUARTERS):
            for word, (r1, r2) in ((m[order[2 * q]], (16, 12)), (m[order[2 * q + 1]], (8, 7))):
                v[a] = (v[a] + v[b] + word) & MASK
                x = v[d] ^ v[a]
                v[d] = (x >> r1 | x << 32 - r1) & MASK
                v[c] = (v[c] + v[d]) & MASK
                x = v[b] ^ v[c]
                v[b] = (x >> r2 | x << 32 - r2) & MASK
    return [v[i] ^ v[i + 8] for i in range(8)] + [v[i + 8] ^ cv[i] for i in range(8)]


def _chunk(data: bytes, counter: int, root: int) -> list[int]:
    cv = IV
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        flags = (CHUNK_START if k == 0 else 0) | (CHUNK_END | root if last else 0)
        out = _compress(cv, block, counter, len(block), flags)
        cv = tuple(out[:8])
    return out


def digest(data: bytes) -> bytes:
    """32 bytes."""
    if len(data) <= CHUNK:
        return struct.pack("<8I", *_chunk(data, 0, ROOT)[:8])
    stack: list[tuple[int, ...]] = []
    chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
    join = lambda a, b, root: _compress(IV, struct.pack("<16I", *a, *b), 0, BLOCK, PARENT | root)
    for n, c in enumerate(chunks[:-1], 1):
        cv = tuple(_chunk(c, n - 1, 0)[:8])
        while n % 2 == 0:  # a full subtree on each trailing zero bit
            cv = tuple(join(stack.pop(), cv, 0)[:8])
            n //= 2
        stack.append(cv)
    cv = tuple(_chunk(chunks[-1], len(chunks) - 1, 0)[:8])
    while stack:
        out = join(stack.pop(), cv, ROOT if not stack else 0)
        cv = tuple(out[:8])
    return struct.pack("<8I", *out[:8])


def short_hash(data: bytes) -> str:
    """The first 8 bytes in hexadecimal, which files are compared by."""
    return digest(data)[:8].hex()


def _mix(cv: np.ndarray, m: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """One compression for each lane: chaining values (8, n) and messages (16, n) to new chaining values."""
    n = cv.shape[1]
    v = np.empty((16, n), np.uint32)
    v[:8] = cv
    v[8:12] = np.array(IV[:4], np.uint32)[:, None]
    v[12], v[13], v[14], v[15] = counter, 0, length, flags
    for order in _SCHEDULES:
        for q, (a, b, c, d) in enumerate(_QUARTERS):
            for word, (r1, r2) in ((m[order[2 * q]], (16, 12)), (m[order[2 * q + 1]], (8, 7))):
                v[a] += v[b] + word
                x = v[d] ^ v[a]
                v[d] = x >> np.uint32(r1) | x << np.uint32(32 - r1)
                v[c] += v[d]
                x = v[b] ^ v[c]
                v[b] = x >> np.uint32(r2) | x << np.uint32(32 - r2)
    return v[:8] ^ v[8:]


def short_hashes(items: list[bytes]) -> list[str]:
    """short_hash of many contents at once: all their chunks go through the rounds side by side."""
    if not items:
        return []
    counts = np.array([max(1, -(-len(x) // CHUNK)) for x in items])
    owner = np.repeat(np.arange(len(items)), counts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    number = np.arange(len(owner)) - first[owner]
    size = np.minimum(np.array([len(x) for x in items])[owner] - number * CHUNK, CHUNK)
    data = np.zeros((len(owner), CHUNK), np.uint8)
    flat = data.reshape(-1)
    for x, at in zip(items, first * CHUNK, strict=True):
        flat[at : at + len(x)] = np.frombuffer(x, np.uint8)
    words = data.view("<u4")
    blocks = np.maximum(1, -(-size // BLOCK))
    cv = np.repeat(np.array(IV, np.uint32)[:, None], len(owner), axis=1)
    single = counts[owner] == 1
    for k in range(int(blocks.max())):
        live = np.flatnonzero(blocks > k)
        last = blocks[live] == k + 1
        flags = (CHUNK_START if k == 0 else 0) | np.where(last, CHUNK_END, 0) | np.where(last & single[live], ROOT, 0)
        length = np.clip(size[live] - k * BLOCK, 0, BLOCK)
        cv[:, live] = _mix(cv[:, live], words[live, 16 * k : 16 * k + 16].T, number[live].astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32))
    # Neighbours are joined level by level; one without a neighbour moves up as it is.
    while (counts > 1).any():
        left = np.flatnonzero((number % 2 == 0) & (number + 1 < counts[owner]))
        root = np.where(counts[owner[left]] == 2, PARENT | ROOT, PARENT).astype(np.uint32)
        iv = np.repeat(np.array(IV, np.uint32)[:, None], len(left), axis=1)
        cv[:, left] = _mix(iv, np.concatenate([cv[:, left], cv[:, left + 1]]), np.zeros(len(left), np.uint32), np.full(len(left), BLOCK, np.uint32), root)
        keep = number % 2 == 0
        cv, owner, number = cv[:, keep], owner[keep], number[keep] // 2
        counts = (counts + 1) // 2
    raw = cv[:2].T.astype("<u4").tobytes()
    return [raw[8 * k : 8 * k + 8].hex() for k in range(len(items))]

"""Words of many texts at once, and their XXH64, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Words are runs of bytes outside these (space, and 0x09 to 0x0D).
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text that are handled at a time.
BLOCK_BYTES = 1 << 19

# The primes of XXH64.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)


class Words(NamedTuple):
    """buf: the words of all texts, each followed by one blank, padded by 32 bytes."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    #: first[i]:first[i + 1] are the words of text i.
    first: np.ndarray


def blocks(sizes: np.ndarray, limit: int = BLOCK_BYTES):
    """Ranges of rows that hold about `limit` bytes, or one row that holds more."""
    lo, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def byte_sizes(text: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def words(texts: list[bytes]) -> Words:
    """The words of each text; texts of no words have none."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[raw]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    keep = ~(space & before)
    buf = raw[keep]
    space = space[keep]
    # of each text: how many kept bytes stand before its end
    cut = np.cumsum([len(t) + 1 for t in texts])
    ends = np.flatnonzero(space)
    starts = np.empty_like(ends)
    if len(ends):
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
    kept = np.cumsum(keep)[cut - 1]
    first = np.concatenate([[0], np.searchsorted(ends, kept)])
    buf = buf.copy()
    buf[space] = 0x20
    return Words(np.concatenate([buf, np.zeros(32, np.uint8)]), starts, ends, first)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buf[start[i]:end[i]] for every i; buf has 8 spare bytes at least."""
    with np.errstate(over="ignore"):
        wide = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
        half = np.ndarray((len(buf) - 3,), "<u4", buf, strides=(1,))
        size = end - start
        s = np.uint64(seed)
        h = np.full(len(start), s + P5, np.uint64)
        at = start.astype(np.int64, copy=True)
        long = np.flatnonzero(size >= 32)
        if len(long):
            v = [np.full(len(long), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            pos, stop = at[long], end[long] - 32
            live = np.arange(len(long))
            while len(live):
                p = pos[live]
                for k in range(4):
                    v[k][live] = _round(v[k][live], wide[p + 8 * k])
                pos[live] = p + 32
                live = live[pos[live] <= stop[live]]
            x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for k in range(4):
                x = (x ^ _round(np.uint64(0), v[k])) * P1 + P4
            h[long] = x
            at[long] = pos
        h += size.astype(np.uint64)
        live = np.flatnonzero(end - at >= 8)
        while len(live):
            p = at[live]
            h[live] = _rotl(h[live] ^ _round(np.uint64(0), wide[p]), 27) * P1 + P4
            at[live] = p + 8
            live = live[end[live] - at[live] >= 8]
        live = np.flatnonzero(end - at >= 4)
        if len(live):
            p = at[live]
            h[live] = _rotl(h[live] ^ (half[p].astype(np.uint64) * P1), 23) * P2 + P3
            at[live] = p + 4
        live = np.flatnonzero(end > at)
        while len(live):
            p = at[live]
            h[live] = _rotl(h[live] ^ (buf[p].astype(np.uint64) * P5), 11) * P1
            at[live] = p + 1
            live = live[end[live] > at[live]]
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer, so that low bits depend on all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))

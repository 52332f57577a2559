"""Hashes of many byte spans at once, for texts as Arrow holds them."""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15
_BLOCK = 1 << 17


def _finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_P), _powers(pow(_P, -1, 1 << 64))
#: A number for every byte, and the same with A-Z as a-z.
EXACT = _finished(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
LOWER = EXACT.copy()
LOWER[65:91] = EXACT[97:123]


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the places where its texts begin and the last ends; null counts as empty."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    held = column.buffers()[2] if len(column) else None
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def owners(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that holds each place."""
    return np.searchsorted(offsets, at, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = EXACT) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and don't overlap.

    Within a block, the sum of each byte's number times a power of an odd
    constant gives all spans by differences; a span longer than a block is
    hashed by the hashes of its parts.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        stop = int(np.searchsorted(ends, base + _BLOCK - 1, "right"))
        if stop <= at:
            cuts = np.append(np.arange(base, int(ends[at]), _BLOCK - 1), ends[at])
            parts = hashes(data, cuts[:-1], cuts[1:], table)
            out[at] = _finished(np.bitwise_xor.reduce(_finished(parts + np.arange(1, len(parts) + 1, dtype=np.uint64) * np.uint64(_P)), keepdims=True))[0]
            at += 1
            continue
        part = data[base : int(ends[stop - 1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * _UP[: len(part)], out=sums[1:])
        first, last = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = _finished((sums[last] - sums[first]) * _DOWN[first] + (last - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        at = stop
    return out


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of all words; no word reaches over the end of its text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = solid & (edge[:-1] | np.concatenate([[True], ~solid[:-1]]))
    closes = solid & (edge[1:] | np.concatenate([~solid[1:], [True]]))
    return np.flatnonzero(begins), np.flatnonzero(closes) + 1

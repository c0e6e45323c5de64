"""Hashes of runs of words, and rows that pack many entries (hash, document) of one bucket to travel by."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bits of a bucket's number at most.
MAX_BITS = 23
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(w) for w in words], np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling(hashes: np.ndarray, size: int, which: int) -> np.ndarray:
    """A 64-bit hash of each run of size hashes, equal wherever the run stands."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = MULTIPLIERS[which]
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(base, len(hashes)), dtype=np.uint64, out=total[1:])
    h = (total[size:] - total[:n]) * _powers(pow(base, -1, 1 << 64), n)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def packed(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def _width(span: int) -> int:
    return max(1, (span.bit_length() + 7) // 8)


def groups(*sorted_by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group of equal rows begins in arrays that are ordered by them, and its rows."""
    n = len(sorted_by[0])
    edge = np.zeros(n, bool)
    edge[:1] = True
    for x in sorted_by:
        edge[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(edge)
    return first, np.diff(np.concatenate([first, [n]]))


def rows_by_bucket(bucket: np.ndarray, ids: np.ndarray, parts: list[tuple[np.ndarray, int]], base: int | None = None):
    """(bucket, base, packed ids above it, packed parts...) for each bucket that has entries; base: the least id, where it isn't given."""
    base = int(ids.min()) if base is None else base
    columns = [((ids - base).astype(np.uint64), _width(int(ids.max()) - base)), *parts]
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [(x[order], w) for x, w in columns]
    columns = [np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :w]) for x, w in columns]
    first, size = groups(bucket)
    for a, n in zip(first.tolist(), size.tolist(), strict=True):
        yield (int(bucket[a]), base, *(x[a : a + n].tobytes() for x in columns))


def ids_of(base: int, data: bytes, n: int) -> np.ndarray:
    return unpacked(data, len(data) // n).astype(np.int64) + base


#: Rows of a batch that whole_groups() turns into Python's objects at once.
ROWS_AT_ONCE = 256


def whole_groups(batches, columns):
    """(key, columns) of all rows of a key, of batches that are ordered by their first column. A batch may be all that a task reads, so that it is taken in slices."""
    key, held = None, []
    for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
        rows = [batch.column(c).to_pylist() for c in columns]
        for row in zip(*rows, strict=True):
            if row[0] != key and held:
                yield key, held
                held = []
            key = row[0]
            held.append(row[1:])
    if held:
        yield key, held

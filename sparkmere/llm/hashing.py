"""Words and hashes of whole UTF-8 texts, by array operations over their bytes."""

from __future__ import annotations

import functools

import numpy as np
import xxhash

U64 = np.uint64
_BASE = 0x9E6C63D0876A9A47  # odd, so it has an inverse modulo 2**64
_LONG = 256  # spans beyond this are hashed one by one


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p, dtype=U64))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64 bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def byte_class(inside: str) -> np.ndarray:
    """256 booleans. 'alnum': ASCII letters, digits and all bytes of other characters. 'text': all but \\x20 and \\x09-\\x0D."""
    table = np.zeros(256, bool)
    if inside == "alnum":
        table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    else:
        table[:] = True
        table[0x20] = False
        table[0x09:0x0E] = False
    return table


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it (one entry more than rows). Words end with their row."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    m = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    before &= ~edge[:n]
    starts = np.flatnonzero(m & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; zeros beyond the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], U64)  # masks of the first n bytes


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each span data[start:end]. Equal bytes have equal hashes, wherever they stand.

    Eight bytes at a time go through a bijection, so spans of up to 8 bytes and equal length never collide. Lanes are hashes
    that are independent of each other: two of them make 128 bits.
    """
    size = ends - starts
    h = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(lane * 0xD6E8FEB86659FD93 + 1 & (1 << 64) - 1))
    eights = _eights(data)
    at, left, who = starts, size, None
    for i in range(0, _LONG, 8):
        some = np.flatnonzero(left > 0)
        if not len(some):
            break
        if len(some) < len(left):
            at, left = at[some], left[some]
            who = some if who is None else who[some]
        x = eights[at] & _KEEP[np.minimum(left, 8)]
        if who is None:
            h = mix(h ^ x)
        else:
            h[who] = mix(h[who] ^ x)
        at, left = at + 8, left - 8
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), lane)
    return h


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Booleans: data[a:a+size] == data[b:b+size], byte by byte."""
    eights, out = _eights(data), np.ones(len(a), bool)
    who = np.flatnonzero((size > 0) & (a != b))
    done = 0
    while len(who):
        keep = _KEEP[np.minimum(size[who] - done, 8)]
        out[who] = (eights[a[who] + done] & keep) == (eights[b[who] + done] & keep)
        done += 8
        who = who[out[who] & (size[who] > done)]
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive entries: len(words) - k + 1 of them (none if there are fewer entries)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.zeros(n, U64)
    for i in range(k):
        h *= U64(_BASE)
        h += words[i : i + n]
    return mix(h)


def gram_hashes_at(words: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """gram_hashes(words, k)[places], for few places."""
    h = np.zeros(len(places), U64)
    for i in range(k):
        h *= U64(_BASE)
        h += words[places + i]
    return mix(h)


def inside(before: np.ndarray, k: int) -> np.ndarray:
    """Of all starts of k-grams over concatenated rows, which lie within one row: booleans for len(entries) - k + 1 starts."""
    total = int(before[-1])
    n = max(0, total - k + 1)
    ok = np.ones(n, bool)
    if n and k > 1:
        bad = np.zeros(n + 1, np.int64)
        for edge in before[1:-1]:  # starts edge-k+1 .. edge-1 cross it
            lo, hi = max(0, edge - k + 1), min(n, edge)
            if lo < hi:
                bad[lo] += 1
                bad[hi] -= 1
        ok = np.cumsum(bad[:n]) == 0
    return ok


def coverage(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Booleans: which of n places lie in some [start, end)."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive entries, by doubling."""
    size, out = 1, x
    while size * 2 <= w:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    if size < w:
        n = len(x) - w + 1
        out = np.minimum(out[:n], out[w - size : w - size + n])
    return out

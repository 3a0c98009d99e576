"""Column-wise construction of the Burrows-Wheeler transform of many short byte strings, with common prefixes.

Round j inserts the suffix of length j of every string that is long enough: one symbol per string. The transform of the
suffixes so far gives each new suffix its place (a stable sort of the symbols is the LF mapping), and each new common
prefix is one more than the least between two neighbouring occurrences of its first symbol. The lists of a round are
read and written front to back, as files would be; callers bound the collection, so they are kept in memory.
"""

from __future__ import annotations

import numpy as np


def sorted_suffixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, common): start places in data of all non-empty suffixes of the strings data[start:end] in order, and the
    length, `cap` at most, of the prefix that each shares with the one before it. Equal suffixes are ordered by string."""
    m = len(starts)
    ends = ends.astype(np.int64)
    size = ends - starts
    strings = np.arange(m)
    # the m empty suffixes; symbols are byte + 1, and 0 is the end of a string; 257 values need 16 bits only for byte 255
    def before(which: np.ndarray, j: int) -> np.ndarray:
        at = ends[which] - j - 1
        inside = at >= starts[which]
        out = np.zeros(len(which), np.uint16)
        out[inside] = data[at[inside]].astype(np.uint16) + 1
        return out

    symbol = before(strings, 0)
    narrow = bool(len(data) == 0 or data.max() < 255)
    symbol = symbol.astype(np.uint8) if narrow else symbol
    common = np.zeros(m, np.uint8)
    ids = np.full(m, -1, np.int32)
    active, place = strings, np.arange(m)
    for j in range(1, int(size.max(initial=0)) + 1):
        going = size[active] >= j
        active, place = active[going], place[going]
        order = np.argsort(symbol, kind="stable")
        ended = int(np.count_nonzero(symbol == 0))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        r = rank[place]
        by = np.argsort(r, kind="stable")
        active, r = active[by], r[by]
        at = m + r - ended  # in the new list
        # common prefixes of the new suffixes and of those right after them
        look = np.unique(np.concatenate([r, r[r + 1 < len(order)] + 1]))
        same = symbol[order[look]] == symbol[order[look - 1]]
        same &= look > ended
        value = np.zeros(len(look), np.uint8)
        if same.any():
            p, q = order[look[same]], order[look[same] - 1]
            pairs = np.stack([q + 1, p + 1], 1).ravel()
            padded = np.append(common, np.uint8(0))
            least = np.minimum.reduceat(padded, pairs)[::2]
            value[same] = np.minimum(least.astype(np.int16) + 1, cap).astype(np.uint8)
        fresh = np.zeros(len(symbol) + len(at), bool)
        fresh[at] = True
        old = ~fresh
        new_symbol, new_common, new_ids = np.empty(len(fresh), symbol.dtype), np.empty(len(fresh), np.uint8), np.empty(len(fresh), np.int32)
        new_symbol[old], new_common[old], new_ids[old] = symbol, common, ids
        new_symbol[at] = before(active, j)
        new_ids[at] = ends[active] - j
        new_common[m + look - ended] = value
        symbol, common, ids, place = new_symbol, new_common, new_ids, at
    return ids[m:].astype(np.int64), common[m:]

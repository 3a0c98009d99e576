"""Meeting of equal hashes from all documents, with arrays instead of rows.

A scan gives, for each batch of documents, arrays of (hash, document, place). They are cut by hash into buckets and
travel as one binary value per batch and bucket, so Spark shuffles few rows and no Python object exists per hash. Each
bucket is then one group of bounded size: buckets grow in number with the input. Before the shuffle every batch keeps one
entry of a hash (its first by document and place), so a hash that a third of all documents share adds one entry a batch.
"""

from __future__ import annotations

import numpy as np


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """By the high bits, evenly for any number of buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packed(columns: list[np.ndarray], bucket: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """(bucket, its entries) for arrays of equal length. A payload is the number of entries, then each column in full."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cols = [c[order] for c in columns]
    edges = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
    ends = np.append(edges[1:], len(b))
    ids = b[edges].tolist()
    out = []
    for s, e in zip(edges.tolist(), ends.tolist(), strict=True):
        out.append(b"".join([np.int64(e - s).tobytes(), *[c[s:e].tobytes() for c in cols]]))
    return ids, out


def unpacked(payloads: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for p in payloads:
        n, at = int(np.frombuffer(p, np.int64, 1)[0]), 8
        for i, k in enumerate(kinds):
            size = np.dtype(k).itemsize * n
            parts[i].append(np.frombuffer(p, k, n, at))
            at += size
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(parts, kinds, strict=True)]


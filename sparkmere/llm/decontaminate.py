"""Benchmark decontamination by winnowing.

Words are lower-cased runs of letters and digits. A window is 10 consecutive words of a benchmark item; an item with
fewer words is one window. Of all 5-gram hashes of a text, winnowing keeps the least of each 6 in a row (the leftmost on
ties): a shared run of 10 words holds 6 5-grams, the same one is kept in both texts, so no such run is missed. Kept
hashes of documents are looked up among those of the benchmark; around each hit the up to 6 windows that hold the 5-gram
are compared with the benchmark's windows by hash and then word by word. Windows of short items are compared at every place.

The benchmark is cut into blocks of items of a stated size (block_bytes); each block is one broadcast of bounded size,
and documents pass through one narrow step a block. So neither table is shuffled, and a benchmark of any size works.

Defined cases: a null text has no words; an item without words has no window; repeated items count once by item_id;
items without id are ignored; repeated documents each get their result; empty tables give no hits; extra columns are
kept, result columns win over clashing names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, groups, strings
from .hashing import byte_class, coverage, gram_hashes, gram_hashes_at, inside, lower_ascii, runs, sliding_min, span_hashes, word_bounds

WINDOW, GRAM, KEPT = 10, 5, 6  # GRAM + KEPT - 1 == WINDOW
_ALNUM = byte_class("alnum")
FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def kept_grams(grams: np.ndarray) -> np.ndarray:
    """Positions that winnowing keeps among the gram hashes of one text. High hash bits with the position below them: the least is leftmost on ties."""
    n = len(grams) - KEPT + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = sliding_min(grams, KEPT)
    out = np.full(n, -1, np.int64)
    for i in range(KEPT - 1, -1, -1):
        out[grams[i : i + n] == least] = i
    return np.unique(out + np.arange(n))


class Index:
    """Windows and kept grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]]):
        self.windows: dict[int, dict[int, dict[bytes, list[str]]]] = {}
        grams: list[np.ndarray] = []
        for item, text in items:
            data = lower_ascii(np.frombuffer(text.encode(), np.uint8))
            starts, ends, _ = word_bounds(data, np.array([0, len(data)]), _ALNUM)
            n = len(starts)
            if not n:
                continue
            h = span_hashes(data, starts, ends)
            size = min(n, WINDOW)
            words = [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
            for i, key in enumerate(gram_hashes(h, size).tolist()):
                ids = self.windows.setdefault(size, {}).setdefault(key, {}).setdefault(b" ".join(words[i : i + size]), [])
                if item not in ids:
                    ids.append(item)
            if n >= WINDOW:
                g = gram_hashes(h, GRAM)
                grams.append(g[kept_grams(g)])
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        self.hashes = {size: np.array(sorted(keys), np.uint64) for size, keys in self.windows.items()}


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(x):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def find(index: Index, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """For each row: number of words, spans of hit words, ids of items with a window in it."""
    data = lower_ascii(data)
    starts, ends, before = word_bounds(data, offs, _ALNUM)
    h = span_hashes(data, starts, ends)
    n = len(offs) - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[set[str]] = [set() for _ in range(n)]
    row = np.repeat(np.arange(n), np.diff(before))
    for size, table in index.hashes.items():
        if len(h) < size:
            continue
        ok = inside(before, size)
        if size == WINDOW:
            g = gram_hashes(h, GRAM)
            least = sliding_min(g, KEPT)  # one for each window of 10 words
            # a window's kept gram must be the benchmark's; windows that cross rows are masked out below
            places = np.flatnonzero(ok & _among(least, index.grams))
        else:
            places = np.flatnonzero(ok)
        if not len(places):
            continue
        keys = gram_hashes_at(h, places, size)
        hit = _among(keys, table)
        for p, key in zip(places[hit].tolist(), keys[hit].tolist(), strict=True):
            words = b" ".join(data[starts[q] : ends[q]].tobytes() for q in range(p, p + size))
            ids = index.windows[size][key].get(words)
            if ids:
                r = row[p]
                items[r].update(ids)
                spans[r].append((p - int(before[r]), p - int(before[r]) + size))
    return np.diff(before), spans, items


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """docs with n_words, hit_spans (maximal runs of hit words, [start, end) in words) and items (ids as strings, sorted)."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size) // block_bytes + 1
    out = docs
    for b in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        held = spark.sparkContext.broadcast(sorted({(r[0], r[1]) for r in part.collect()}))  # about block_bytes
        first = b == 0

        def make(held=held, first=first):
            index = Index(held.value)

            def work(columns: list[pa.Array]) -> list[pa.Array]:
                data, offs = strings(columns[0])
                counts, all_spans, all_items = [], [], []
                old_spans = old_items = None
                if not first:
                    old_spans, old_items = columns[1].to_pylist(), columns[2].to_pylist()
                for i, j in groups(offs):
                    n, spans, items = find(index, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    counts.append(n)
                    all_spans += spans
                    all_items += items
                for r in range(len(offs) - 1):
                    here = [*all_spans[r], *(map(tuple, old_spans[r]) if old_spans else ())]
                    if here:
                        a = np.array(here, np.int64)
                        s, e = runs(coverage(int(a[:, 1].max()), a[:, 0], a[:, 1]))
                        all_spans[r] = np.stack([s, e], 1).tolist()
                    all_items[r] = sorted({*all_items[r], *(old_items[r] if old_items else ())})
                return [pa.array(np.concatenate(counts), pa.int64()), pa.array(all_spans, pa.list_(pa.list_(pa.int64()))), pa.array(all_items, pa.list_(pa.string()))]

            return work

        out = annotate(out, [text] if first else [text, "hit_spans", "items"], FIELDS, make)
    return out

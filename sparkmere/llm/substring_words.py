"""Substring dedup over words, by difference-cover anchors.

A window is 13 consecutive words; a word goes if a window that covers it also starts in a document with a smaller id.

Cover: of every 7 consecutive places those at 0, 1 and 3 modulo 7 are anchors, and {0, 1, 3} is a difference cover: for any
two places i and j some shift l < 7 makes both i+l and j+l anchors. So two equal windows of 13 words, wherever they start,
share an aligned anchor whose 7 words lie within both. Only 7-grams at anchors are hashed and met (3 of 7 places).

1. Anchors meet by hash. A window can repeat only if one of the 3 anchors in its first 7 places is found more than once.
2. Such windows extend from their anchors to all 13 words: their full hashes, of 128 bits, meet, with the ids of their documents, and
   every window that isn't in its smallest document goes.

Hashes travel as arrays (see exchange). Every batch passes on one entry of a hash that it holds more than once, so a
passage of a third of all documents adds one entry a batch; every list that is gathered belongs to one bucket of hashes or
one batch of documents; buckets grow in number with the text, but all entries of one hash meet in one. Texts are shuffled only for documents that have candidates (a bitmap of
fixed size tells), not for the others.

Defined cases: null text has no words; a null id is never smaller nor larger, so such a row is kept whole; rows with
equal ids don't remove from each other; fewer than 13 words: nothing is removed; empty table: no rows; other input
columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, parts_for, probable_members, strings, text_bytes, tidy, tidy_group, written
from .exchange import bucket_of, packed, unpacked
from .hashing import byte_class, coverage, gram_hashes, gram_hashes_at, runs, span_hashes, word_bounds

WINDOW, PERIOD, COVER, GRAM = 13, 7, (0, 1, 3), 7  # PERIOD - 1 + GRAM == WINDOW
_TEXT = byte_class("text")
BATCH_BYTES = 8 << 20
ENTRIES, TABLE, FLAGS = 0, 1, 2
SCAN = "bucket int, batch long, kind int, payload binary"
MET = "batch long, kind int, payload binary"
_SCAN_NAMES, _MET_NAMES = ["bucket", "batch", "kind", "payload"], ["batch", "kind", "payload"]
MARK = 0xFFFF  # in the place of a row: the batch knows already that this hash repeats


def table_of(batch: int, docs: np.ndarray, marks: np.ndarray, sizes: np.ndarray, rows: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """Rows of a batch's own: the table of its documents and what it flagged itself."""
    bucket = batch % 1009
    return [
        (bucket, batch, TABLE, packed([docs, marks, sizes], np.zeros(len(docs), np.int64), 1)[1][0]),
        *([(bucket, batch, FLAGS, packed([rows.astype(np.uint16), at.astype(np.uint32)], np.zeros(len(rows), np.int64), 1)[1][0])] if len(rows) else []),
    ]


def batch_id(docs: np.ndarray, marks: np.ndarray) -> int:
    """The same whenever the same rows are read again, so a task that runs twice gives the same rows."""
    return xxhash.xxh64_intdigest(docs.tobytes() + marks.tobytes()) >> 1


def scan_rows(out: list[tuple[int, int, int, bytes]], buckets: int) -> pa.RecordBatch:
    b, batch, kind, payload = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([x % buckets for x in b], pa.int32()), pa.array(batch, pa.int64()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], names=_SCAN_NAMES)


def slices(batch: pa.RecordBatch, doc: int, mark: int, text: int, batch_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, slice]]:
    """(ids, text marks, bytes, offsets, rows) of parts of bounded size."""
    data, offs = strings(batch.column(text))
    ids, marks = batch.column(doc).to_numpy(), batch.column(mark).to_numpy()
    for i, j in groups(offs, batch_bytes):
        while i < j:  # rows are numbered with 16 bits
            k = min(j, i + MARK)
            yield ids[i:k], marks[i:k], data[offs[i] : offs[k]], offs[i : k + 1] - offs[i], slice(i, k)
            i = k


def anchor_places(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, row, place in the row) of all anchors whose gram lies within its row."""
    n = int(before[-1])
    row = np.repeat(np.arange(len(before) - 1), np.diff(before))
    place = np.arange(n) - before[row]
    ok = np.isin(place % PERIOD, COVER) & (place + GRAM <= np.diff(before)[row])
    at = np.flatnonzero(ok)
    return at, row[at], place[at]


def by_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, sizes): entries sorted by hash, stable; starts and sizes of the groups of equal ones."""
    order = np.argsort(h, kind="stable")
    k = h[order]
    starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return order, starts, np.diff(np.append(starts, len(k)))


def scan_anchors(buckets: int, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, marks, data, offs, _ in slices(b, 0, 1, 2, batch_bytes):
                starts, ends, before = word_bounds(data, offs, _TEXT)
                words = span_hashes(data, starts, ends)
                at, row, place = anchor_places(before)
                h = gram_hashes(words, GRAM)[at]
                order, first, size = by_hash(h)
                twice = np.repeat(size > 1, size)
                again = np.sort(order[twice])
                once = np.sort(order[~twice])
                lead = order[first[size > 1]]
                h, row16 = np.concatenate([h[once], h[lead]]), np.concatenate([row[once], np.full(len(lead), MARK)]).astype(np.uint16)
                place32 = np.concatenate([place[once], np.zeros(len(lead), np.int64)]).astype(np.uint32)
                batch = batch_id(ids, marks)
                out = table_of(batch, ids, marks, np.diff(before), row[again], place[again])
                out += [(k, batch, ENTRIES, p) for k, p in zip(*packed([h, row16, place32], bucket_of(h, buckets), buckets), strict=True)]
                yield scan_rows(out, buckets)

    return run


def split(table: pa.Table) -> tuple[list[int], list[bytes], list[tuple[int, int, bytes]]]:
    """Batches and payloads of the entries, sorted so that the result doesn't depend on the order of arrival; and rows to pass on."""
    rows = sorted(zip(table["kind"].to_pylist(), table["batch"].to_pylist(), table["payload"].to_pylist(), strict=True))
    mine = [(b, p) for k, b, p in rows if k == ENTRIES]
    return [b for b, _ in mine], [p for _, p in mine], [(b, k, p) for k, b, p in rows if k != ENTRIES]


def flags_out(batches: list[int], source: np.ndarray, row: np.ndarray, place: np.ndarray, passed: list[tuple[int, int, bytes]]) -> pa.Table:
    """Flagged entries, back to the batches that they came from."""
    out = list(passed)
    if len(source):
        ids, payloads = packed([row, place], source, len(batches))
        out += [(batches[i], FLAGS, p) for i, p in zip(ids, payloads, strict=True)]
    cols = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=_MET_NAMES)


def sources(payloads: list[bytes]) -> np.ndarray:
    return np.repeat(np.arange(len(payloads)), [int(np.frombuffer(p, np.int64, 1)[0]) for p in payloads])


def meet_anchors(table: pa.Table) -> pa.Table:
    batches, payloads, passed = split(table)
    h, row, place = unpacked(payloads, ["u8", "u2", "u4"])
    order, _, size = by_hash(h)
    hit = np.sort(order[np.repeat(size > 1, size)])
    hit = hit[row[hit] != MARK]
    return flags_out(batches, sources(payloads)[hit], row[hit], place[hit], passed)


def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A batch's documents, and the rows and places of all its flags. A batch that was read twice counts once."""
    kinds, payloads = table["kind"].to_pylist(), table["payload"].to_pylist()
    docs, marks, sizes = unpacked([p for k, p in zip(kinds, payloads, strict=True) if k == TABLE][:1], ["i8", "i8", "i8"])
    row, place = unpacked([p for k, p in zip(kinds, payloads, strict=True) if k == FLAGS], ["u2", "u4"])
    return docs, marks, sizes, row.astype(np.int64), place.astype(np.int64)


FOUND = "doc long, mark long, found binary"


def found_table(docs: list[int], marks: list[int], found: list[bytes]) -> pa.Table:
    return pa.table([pa.array(docs, pa.int64()), pa.array(marks, pa.int64()), pa.array(found, pa.binary())], names=["doc", "mark", "found"])


def candidate_windows(table: pa.Table) -> pa.Table:
    """Of each document the runs [first, end) of window starts with an anchor that was found more than once."""
    docs, marks, sizes, row, place = gathered(table)
    order = np.argsort(row, kind="stable")
    row, place = row[order], place[order]
    edge = np.searchsorted(row, np.arange(len(docs) + 1))
    out: tuple[list, list, list] = ([], [], [])
    for r in np.flatnonzero(np.diff(edge)):
        n = int(sizes[r]) - WINDOW + 1
        if n <= 0:
            continue
        p = place[edge[r] : edge[r + 1]]
        s, e = runs(coverage(n, np.maximum(0, p - PERIOD + 1), np.minimum(n, p + 1)))
        if len(s):
            out[0].append(int(docs[r]))
            out[1].append(int(marks[r]))
            out[2].append(np.stack([s, e]).astype(np.uint32).tobytes())
    return found_table(*out)


def spans_of(found: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(found, np.uint32).astype(np.int64).reshape(2, -1)
    return a[0], a[1]


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All whole numbers in the ranges."""
    size = ends - starts
    total = int(size.sum())
    return np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(total)


def after_the_least(h: np.ndarray, more: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, booleans in that order): which entries have a larger document than another of the same 128 bits."""
    order = np.lexsort((doc, more, h))
    a, b = h[order], more[order]
    first = np.ones(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = doc[order[np.flatnonzero(first)[np.cumsum(first) - 1]]] if len(order) else doc
    return order, doc[order] > least


def scan_windows(buckets: int, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column(3)
            for ids, marks, data, offs, at in slices(b, 0, 1, 2, batch_bytes):
                starts, ends, before = word_bounds(data, offs, _TEXT)
                places, rows = [], []
                for r in range(len(ids)):
                    p = ranges(*spans_of(found[at.start + r].as_py()))
                    places.append(p)
                    rows.append(np.full(len(p), r))
                place, row = np.concatenate(places), np.concatenate(rows)
                h, more = (gram_hashes_at(span_hashes(data, starts, ends, lane), place + before[row], WINDOW) for lane in (0, 1))
                doc = ids[row]
                order, later = after_the_least(h, more, doc)
                gone, sent = np.sort(order[later]), np.sort(order[~later])
                batch = batch_id(ids, marks)
                out = table_of(batch, ids, marks, np.diff(before), row[gone], place[gone])
                hs = h[sent]
                out += [(x, batch, ENTRIES, p) for x, p in zip(*packed([hs, more[sent], doc[sent], row[sent].astype(np.uint16), place[sent].astype(np.uint32)], bucket_of(hs, buckets), buckets), strict=True)]
                yield scan_rows(out, buckets)

    return run


def meet_windows(table: pa.Table) -> pa.Table:
    batches, payloads, passed = split(table)
    h, more, doc, row, place = unpacked(payloads, ["u8", "u8", "i8", "u2", "u4"])
    order, later = after_the_least(h, more, doc)
    hit = np.sort(order[later])
    return flags_out(batches, sources(payloads)[hit], row[hit], place[hit], passed)


def removed_words(table: pa.Table) -> pa.Table:
    """Of each document the runs [first, end) of words to remove."""
    docs, marks, sizes, row, place = gathered(table)
    order = np.argsort(row, kind="stable")
    row, place = row[order], place[order]
    edge = np.searchsorted(row, np.arange(len(docs) + 1))
    out: tuple[list, list, list] = ([], [], [])
    for r in np.flatnonzero(np.diff(edge)):
        p = place[edge[r] : edge[r + 1]]
        s, e = runs(coverage(int(sizes[r]), p, p + WINDOW))
        out[0].append(int(docs[r]))
        out[1].append(int(marks[r]))
        out[2].append(np.stack([s, e]).astype(np.uint32).tobytes())
    return found_table(*out)


def meeting(scan: DataFrame, meet, merge) -> DataFrame:
    return scan.groupBy("bucket").applyInArrow(tidy_group(meet), MET).groupBy("batch").applyInArrow(tidy_group(merge), FOUND).dropDuplicates(["doc", "mark"])


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The key, n_words, removed (runs [first, end) of words), kept_sha256, and kept_text: the kept words joined by a space."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(body).alias("mark"), body.alias("body"))
    buckets = parts_for(docs, size=text_bytes(docs, text))
    ids = ["doc", "mark"]
    cand = written(meeting(rows.where("doc is not null").mapInArrow(tidy(scan_anchors(buckets, batch_bytes)), SCAN), meet_anchors, candidate_windows))
    may, _ = probable_members(rows.where("doc is not null"), cand, ids)
    windows = may.join(cand, ids).select("doc", "mark", "body", "found")
    gone = written(meeting(windows.mapInArrow(tidy(scan_windows(buckets, batch_bytes)), SCAN), meet_windows, removed_words))
    may, clean = probable_members(rows, gone, ids)
    merged = may.join(gone, ids, "left").select("doc", "body", "found").unionByName(clean.select("doc", "body", F.lit(None).cast("binary").alias("found")))
    schema = f"`{key}` long, n_words long, removed array<array<long>>, kept_sha256 string" + ", kept_text string" * with_text
    names = [key, "n_words", "removed", "kept_sha256", "kept_text"][: 4 + with_text]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, digest, kept = [], [], [], []
            for value, found in zip(b.column(1), b.column(2), strict=True):
                words = value.as_py().encode().split()
                n.append(len(words))
                spans = []
                if found.is_valid:
                    s, e = spans_of(found.as_py())
                    spans = np.stack([s, e], 1).tolist()
                    words = [w for a, z in zip([0, *e.tolist()], [*s.tolist(), len(words)], strict=True) for w in words[a:z]]
                removed.append(spans)
                joined = b" ".join(words)
                digest.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    kept.append(joined.decode())
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.list_(pa.list_(pa.int64()))), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(kept, pa.string())] if with_text else []), names=names)

    return merged.mapInArrow(tidy(finish), schema)

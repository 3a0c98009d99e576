"""Substring dedup over bytes, by a suffix array that is built column by column over many pieces of documents.

A byte goes if some 100-byte string that covers it also starts earlier (smaller id, or same document and earlier start).

1. Pieces. The minimizer of a 100-byte string is the least of the hashes of its 69 substrings of 32 bytes (the leftmost
   on ties). Equal strings have equal minimizers, so runs of strings with one minimizer, of 100 to 168 bytes, can be
   compared minimizer by minimizer: no match is lost, no piece is long, and pieces that meet are bounded in number.
2. Pieces meet by minimizer and 128-bit content hash. Of pieces with equal content all but the earliest go whole: each of their
   strings starts earlier too. A minimizer with one content needs no more. This also keeps a passage that a third of all
   documents hold to one piece.
3. The different contents that share a minimizer, and half of what a match holds around it, become strings of a collection. Its Burrows-Wheeler transform and common
   prefixes are built by inserting one symbol of each string a round (see bwt); in suffix order, runs with common
   prefixes of 100 bytes are equal strings, and all but the earliest of a run go. A minimizer with very many contents is
   cut by the offset of its strings from the minimizer, and beyond that by the strings' own hashes: equal ones still meet.

Arrays travel between stages (see exchange); lists belong to one bucket of hashes or one batch of
documents; buckets grow in number with the text, but all entries of one minimizer meet in one.
Texts are shuffled only for documents that have pieces to compare or bytes to remove.

Defined cases: null text is empty; a null id is neither earlier nor later, so such a row is kept whole; rows with equal
ids count as one document whose parts start at equal places; under 100 bytes nothing is removed; an empty table gives no
rows; other input columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import sorted_suffixes
from .common import groups, parts_for, probable_members, strings, text_bytes, tidy, tidy_group, written
from .exchange import bucket_of, packed, unpacked
from .hashing import U64, _powers, coverage, mix, runs, sliding_min, span_hashes
from .substring_words import ENTRIES, FLAGS, MARK, MET, SCAN, batch_id, scan_rows, sources, spans_of, split

LENGTH, GRAM = 100, 32
GRAMS = LENGTH - GRAM + 1
BATCH_BYTES = 8 << 20
COLLECTION_BYTES = 96 << 10
#: Contents of one minimizer that are compared as one group.
GROUP = 4000
TABLE, CANDIDATES = 1, 3
_LOW = U64((1 << 24) - 1)  # places within a batch; BATCH_BYTES and one more segment fit


def segments(batch: pa.RecordBatch, batch_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, ids, marks, place of the segment in its document, bytes, offsets). Long documents are cut into segments that overlap by 99 bytes."""
    data, offs = strings(batch.column(2))
    ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    for i, j in groups(offs, batch_bytes):
        if offs[j] - offs[i] <= batch_bytes:
            while i < j:
                k = min(j, i + MARK)
                yield np.arange(i, k), ids[i:k], marks[i:k], np.zeros(k - i, np.int64), data[offs[i] : offs[k]], offs[i : k + 1] - offs[i]
                i = k
        else:  # one document
            step = batch_bytes - LENGTH + 1
            n = int(offs[j] - offs[i])
            for base in range(0, n - LENGTH + 1, step):
                part = data[offs[i] + base : offs[i] + min(n, base + batch_bytes)]
                yield np.array([i]), ids[i:j], marks[i:j], np.array([base]), part, np.array([0, len(part)])


def gram_minima(data: np.ndarray) -> np.ndarray:
    """For each start of a 100-byte string: 40 bits of its minimizer's hash above its place, which is what the order needs. Empty if data is shorter."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, U64)
    span = 1 << 20
    power, inverse = _powers(span + 4096 + 1)
    parts = []
    for at in range(0, n - GRAM + 1, span):
        seg = data[at : at + span + GRAM - 1]
        total = np.empty(len(seg) + 1, U64)
        total[0] = 0
        np.cumsum((seg.astype(U64) + U64(1)) * power[: len(seg)], dtype=U64, out=total[1:])
        count = len(seg) - GRAM + 1
        parts.append(mix((total[GRAM:] - total[:count]) * inverse[:count]))
    key = np.concatenate(parts)
    key = (key & ~_LOW) | np.arange(len(key), dtype=U64)
    return sliding_min(key, GRAMS)


def changes(*sorted_keys: np.ndarray) -> np.ndarray:
    """Booleans: where one of the keys differs from the entry before; the first entry is one."""
    out = np.ones(len(sorted_keys[0]), bool)
    if len(out):
        out[1:] = False
    for k in sorted_keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, row, start in the row, strings) of all pieces, in order."""
    least = gram_minima(data)
    if not len(least):
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, z
    ok = np.zeros(len(least) + 1, bool)
    size = np.diff(offs)
    for r in np.flatnonzero(size >= LENGTH):
        ok[offs[r] : offs[r + 1] - LENGTH + 1] = True
    ok = ok[: len(least)]
    new = np.empty(len(least), bool)
    new[0] = True
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[1:] |= ~ok[:-1]
    first = np.zeros(len(least) + 1, bool)
    first[offs[:-1][offs[:-1] < len(least)]] = True
    new |= first[: len(least)]
    new &= ok
    start = np.flatnonzero(new)
    stops = np.append(np.flatnonzero(~ok), len(least))
    nxt = np.append(start[1:], len(least))
    count = np.minimum(nxt, stops[np.searchsorted(stops, start)]) - start
    row = np.searchsorted(offs, start, "right") - 1
    spot = (least[start] & _LOW).astype(np.int64)
    return span_hashes(data, spot, spot + GRAM), row, start - offs[row], count


def own_table(batch: int, ids: np.ndarray, marks: np.ndarray, base: np.ndarray, flags: list[np.ndarray]) -> list[tuple[int, int, int, bytes]]:
    one = lambda cols: packed(cols, np.zeros(len(cols[0]), np.int64), 1)[1][0]
    out = [(batch % 1009, batch, TABLE, one([ids, marks, base]))]
    return out + ([(batch % 1009, batch, FLAGS, one(flags))] if len(flags[0]) else [])


def scan_pieces(buckets: int, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, ids, marks, base, data, offs in segments(b, batch_bytes):
                least, row, start, count = pieces(data, offs)
                if not len(least):
                    continue
                at = start + offs[row]
                content, more = (span_hashes(data, at, at + count + LENGTH - 1, lane) for lane in (0, 1))
                order = np.lexsort((start + base[row], ids[row], more, content))
                first = changes(content[order], more[order])
                sent = np.sort(order[first])
                lead = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
                # a repeated row (same id, same place) is not later than itself
                same = (ids[row[order]] == ids[row[lead]]) & ((start + base[row])[order] == (start + base[row])[lead])
                gone = np.sort(order[~first & ~same])
                narrow = lambda x: [row[x].astype(np.uint16), start[x].astype(np.uint32), count[x].astype(np.uint8)]  # noqa: B023, E731
                batch = batch_id(ids, marks + base)
                out = own_table(batch, ids, marks, base, narrow(gone))
                key = least[sent]
                cols = [key, content[sent], more[sent], ids[row[sent]], start[sent] + base[row[sent]], *narrow(sent)]
                out += [(x, batch, ENTRIES, p) for x, p in zip(*packed(cols, bucket_of(mix(key), buckets), buckets), strict=True)]
                yield scan_rows(out, buckets)

    return run


def meet_pieces(table: pa.Table, group: int = GROUP) -> pa.Table:
    batches, payloads, passed = split(table)
    key, content, more, doc, where, row, start, count = unpacked(payloads, ["u8", "u8", "u8", "i8", "i8", "u2", "u4", "u1"])
    source = sources(payloads)
    order = np.lexsort((where, doc, more, content, key))
    out = list(passed)
    if len(order):
        new_key = changes(key[order])
        first = changes(key[order], content[order], more[order])
        lead = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
        later = (doc[order] != doc[lead]) | (where[order] != where[lead])
        contents = np.add.reduceat(first.astype(np.int64), np.flatnonzero(new_key))
        contents = np.repeat(contents, np.diff(np.append(np.flatnonzero(new_key), len(order))))
        gone, cand = order[later], order[first & (contents > 1)]
        bands = np.minimum(255, -(-contents[first & (contents > 1)] // group)).astype(np.uint8)
        for kind, at, cols in ((FLAGS, gone, [row, start, count]), (CANDIDATES, cand, [row, start, count, key])):
            if len(at):
                extra = [bands] if kind == CANDIDATES else []
                ids, parts = packed([x[at] for x in cols] + extra, source[at], len(batches))
                out += [(batches[i], kind, p) for i, p in zip(ids, parts, strict=True)]
    cols = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["batch", "kind", "payload"])


PIECES = "doc long, mark long, gone binary, cand binary"


def by_document(table: pa.Table) -> pa.Table:
    """A batch's findings by document: runs of bytes that go, and pieces [place, strings, minimizer, bands] to compare."""
    kinds, payloads = table["kind"].to_pylist(), table["payload"].to_pylist()
    ids, marks, base = unpacked([p for k, p in zip(kinds, payloads, strict=True) if k == TABLE][:1], ["i8", "i8", "i8"])
    row, start, count = unpacked([p for k, p in zip(kinds, payloads, strict=True) if k == FLAGS], ["u2", "u4", "u1"])
    crow, cstart, ccount, ckey, bands = unpacked([p for k, p in zip(kinds, payloads, strict=True) if k == CANDIDATES], ["u2", "u4", "u1", "u8", "u1"])
    order, corder = np.argsort(row, kind="stable"), np.argsort(crow, kind="stable")
    edge = np.searchsorted(row[order], np.arange(len(ids) + 1))
    cedge = np.searchsorted(crow[corder], np.arange(len(ids) + 1))
    out: tuple[list, list, list, list] = ([], [], [], [])
    for r in np.flatnonzero((np.diff(edge) > 0) | (np.diff(cedge) > 0)):
        mine, cands = order[edge[r] : edge[r + 1]], corder[cedge[r] : cedge[r + 1]]
        gone = cand = b""
        if len(mine):
            s = start[mine].astype(np.int64)
            e = s + count[mine] + LENGTH - 1
            gone = (np.stack(runs(coverage(int(e.max()), s, e))) + base[r]).astype(np.uint32).tobytes()
        if len(cands):
            cand = np.stack([cstart[cands] + base[r], ccount[cands].astype(np.int64), ckey[cands].view(np.int64), bands[cands].astype(np.int64)]).astype(np.int64).tobytes()
        for x, v in zip(out, (int(ids[r]), int(marks[r]), gone, cand), strict=True):
            x.append(v)
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["doc", "mark", "gone", "cand"])


STRINGS = "bucket int, payload binary"


def send_strings(buckets: int):
    """The bytes of the pieces to compare, to the bucket of their minimizer (and band, where it has very many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = strings(b.column(2))
            out: dict[int, tuple[list, list]] = {}
            for r, value in enumerate(b.column(3)):
                doc, mark = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                place, count, key, bands = np.frombuffer(value.as_py(), np.int64).reshape(4, -1)
                text = data[offs[r] : offs[r + 1]]
                for p, n, k, m in zip(place.tolist(), count.tolist(), key.tolist(), bands.tolist(), strict=True):
                    subs = [(p, n, k)] if m <= 1 else list(cut_by_band(text, p, n, k, m))
                    for p2, n2, k2 in subs:
                        rows, parts = out.setdefault(int(mix(np.array([k2], np.int64).view(U64))[0]) % buckets, ([], []))
                        rows.append((k2, doc, mark, p2, n2 + LENGTH - 1))
                        parts.append(text[p2 : p2 + n2 + LENGTH - 1].tobytes())
            ids = sorted(out)
            payloads = [b"".join([np.int64(len(out[i][0])).tobytes(), np.array(out[i][0], np.int64).T.tobytes(), *out[i][1]]) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(payloads, pa.binary())], names=["bucket", "payload"])

    return run


def cut_by_band(text: np.ndarray, place: int, count: int, key: int, bands: int) -> Iterator[tuple[int, int, int]]:
    """Shorter pieces: strings whose offset from the minimizer is in one band; single strings by hash where there are more bands than offsets."""
    least = gram_minima(text[place : place + count + LENGTH - 1])
    offset = (least & _LOW).astype(np.int64) - np.arange(count)  # falls by one from string to string
    wide = max(1, -(-GRAMS // bands))
    band = offset // wide
    cuts = np.flatnonzero(np.diff(band)) + 1
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), count], strict=True):
        k = (key * 1000003 + int(band[s]) + 1) & ((1 << 62) - 1)
        if bands > GRAMS:
            h = int(span_hashes(text, np.array([place + s]), np.array([place + s + LENGTH]))[0])
            k = (k * 1000003 + h % bands) & ((1 << 62) - 1)
        yield place + s, e - s, k


GONE = "doc long, mark long, gone binary"
SIDE = (LENGTH - GRAM) // 2


def comparable(data: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which pieces may share a 100-byte string with another of their key.

    Such a string holds the minimizer and 68 bytes around it, so 34 before it or 34 after it; with those, one of the two
    halves must be another piece's too. Most pieces meet because of a common phrase only, and drop out here.
    """
    spot = np.empty(len(start), np.int64)
    i = 0
    while i < len(start):  # places within a part fit the low bits of the minima
        j = max(i + 1, int(np.searchsorted(start, start[i] + BATCH_BYTES)))
        least = gram_minima(data[start[i] : start[j - 1] + size[j - 1]])
        spot[i:j] = (least[start[i:j] - start[i]] & _LOW).astype(np.int64) + start[i]
        i = j
    out = np.zeros(len(start), bool)
    for a, z in ((spot - SIDE, spot + GRAM), (spot, spot + GRAM + SIDE)):
        there = np.flatnonzero((a >= start) & (z <= start + size))
        order = np.argsort(a[there], kind="stable")
        there = there[order]
        h = mix(span_hashes(data, a[there], z[there]) ^ mix(key[there].astype(U64)))
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        out[there[count[back] > 1]] = True
    return out


def compare(table: pa.Table) -> pa.Table:
    """Equal strings among the pieces of a bucket, a collection of whole minimizers at a time; runs of bytes that go."""
    keys, docs, marks, places, sizes, bodies = [], [], [], [], [], []
    for p in sorted(table["payload"].to_pylist()):
        n = int(np.frombuffer(p, np.int64, 1)[0])
        k, d, m, w, s = np.frombuffer(p, np.int64, 5 * n, 8).reshape(5, n)
        for x, v in zip((keys, docs, marks, places, sizes), (k, d, m, w, s), strict=True):
            x.append(v)
        bodies.append(np.frombuffer(p, np.uint8, offset=8 + 40 * n))
    key, doc, mark, place, size = (np.concatenate(x) for x in (keys, docs, marks, places, sizes))
    data = np.concatenate(bodies)
    start = np.cumsum(size) - size
    keep = np.flatnonzero(comparable(data, start, size, key))
    order = keep[np.argsort(key[keep], kind="stable")]
    new_key = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(order) else np.zeros(0, np.int64)
    total = np.cumsum(size[order])
    found: list[tuple[np.ndarray, np.ndarray]] = []  # (piece, place of a string in it)
    i = 0
    while i < len(new_key):
        low = total[new_key[i] - 1] if new_key[i] else 0
        ends = np.append(new_key[1:], len(order))
        j = max(i + 1, int(np.searchsorted(total[ends - 1], low + COLLECTION_BYTES, "right")))
        mine = order[new_key[i] : ends[j - 1]]
        if len(mine) > 1:
            at, common = sorted_suffixes(data, start[mine], start[mine] + size[mine], LENGTH)
            equal = common >= LENGTH
            s, e = runs(equal)  # s-1 .. e-1 are equal strings
            if len(s):
                group = np.repeat(np.arange(len(s)), e - s + 1)
                members = at[np.repeat(s - 1 - (np.cumsum(e - s + 1) - (e - s + 1)), e - s + 1) + np.arange(int((e - s + 1).sum()))]
                by_start = np.argsort(start[mine])
                piece = mine[by_start][np.searchsorted(start[mine][by_start], members, "right") - 1]
                where = place[piece] + members - start[piece]
                o = np.lexsort((where, doc[piece], group))
                first = np.concatenate(([True], group[o][1:] != group[o][:-1]))
                lead = o[np.flatnonzero(first)[np.cumsum(first) - 1]]
                later = (doc[piece[o]] != doc[piece[lead]]) | (where[o] != where[lead])
                found.append((piece[o[later]], where[o[later]]))
        i = j
    out: tuple[list, list, list] = ([], [], [])
    if found:
        piece, where = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        o = np.lexsort((where, mark[piece], doc[piece]))
        d, m, w = doc[piece[o]], mark[piece[o]], where[o]
        edge = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (m[1:] != m[:-1]))))
        for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(o)], strict=True):
            x = w[s:e]
            a, z = runs(coverage(int(x[-1] - x[0]) + LENGTH, x - x[0], x - x[0] + LENGTH))
            out[0].append(int(d[s]))
            out[1].append(int(m[s]))
            out[2].append((np.stack([a, z]) + x[0]).astype(np.uint32).tobytes())
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["doc", "mark", "gone"])


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", with_bytes: bool = True, batch_bytes: int = BATCH_BYTES, group: int = GROUP) -> DataFrame:
    """The key, n_bytes, removed (maximal runs [first, end) of bytes), kept_sha256, and kept (the remaining bytes)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(body).alias("mark"), body.alias("body"))
    buckets = parts_for(docs, size=text_bytes(docs, text))
    ids = ["doc", "mark"]
    scan = rows.where("doc is not null").mapInArrow(tidy(scan_pieces(buckets, batch_bytes)), SCAN)
    met = written(scan.groupBy("bucket").applyInArrow(tidy_group(functools.partial(meet_pieces, group=group)), MET).groupBy("batch").applyInArrow(tidy_group(by_document), PIECES))
    # a repeated row is met once; a document of several segments has several rows, each with its own pieces
    cand = met.where("length(cand) > 0").select(*ids, "cand").distinct()
    may, _ = probable_members(rows.where("doc is not null"), cand, ids)
    sent = may.dropDuplicates(ids).join(cand, ids).select("doc", "mark", "body", "cand").mapInArrow(tidy(send_strings(buckets)), STRINGS)
    more = sent.groupBy("bucket").applyInArrow(tidy_group(compare), GONE)
    gone = met.where("length(gone) > 0").select(*ids, "gone").unionByName(more).groupBy(*ids).agg(F.array_sort(F.collect_set("gone")).alias("gone"))
    gone = written(gone)
    may, clean = probable_members(rows, gone, ids)
    merged = may.join(gone, ids, "left").select("doc", "body", "gone").unionByName(clean.select("doc", "body", F.lit(None).cast("array<binary>").alias("gone")))
    schema = f"`{key}` long, n_bytes long, removed array<array<long>>, kept_sha256 string" + ", kept binary" * with_bytes
    names = [key, "n_bytes", "removed", "kept_sha256", "kept"][: 4 + with_bytes]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, digest, kept = [], [], [], []
            for value, found in zip(b.column(1), b.column(2), strict=True):
                left = value.as_py().encode()
                n.append(len(left))
                spans: list = []
                if found.is_valid:
                    pairs = [spans_of(x) for x in found.as_py()]
                    s, e = runs(coverage(len(left), np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])))
                    spans = np.stack([s, e], 1).tolist()
                    left = b"".join([left[a:z] for a, z in zip([0, *e.tolist()], [*s.tolist(), len(left)], strict=True)])
                removed.append(spans)
                digest.append(hashlib.sha256(left).hexdigest())
                if with_bytes:
                    kept.append(left)
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.list_(pa.list_(pa.int64()))), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(kept, pa.binary())] if with_bytes else []), names=names)

    return merged.mapInArrow(tidy(finish), schema)

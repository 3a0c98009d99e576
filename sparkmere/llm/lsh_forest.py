"""N-gram Jaccard join of near-duplicate documents by a MinHash LSH forest.

A document is its set of word 5-grams (lower-cased runs of letters and digits; a shorter text is one gram of all its
words). Documents with equal sets form a class, represented by its smallest id, so copies never become pairs.

1. Signatures: 128 minima, laid out as 16 sequences of 8, one for each tree of the forest.
2. Tries: sequences are dealt by tree and by the prefix at which shortening must end: the longest at which the computed
   chance that two documents at the threshold meet in some tree reaches the target recall (0.9995; a prefix of 4 at 0.8).
   Each task sorts the sequences of a subtrie; the common prefixes of neighbours are its nodes.
3. Matched prefixes shorten, node by node from the deepest to that end: a node's members are compared over all 128 minima
   across its children, and pairs whose estimate is within 4 standard deviations of the threshold join their candidate
   groups. Members that longer prefixes have brought together aren't compared again, and a node whose members are all one
   group is done, so for a large group of near copies short prefixes cost little. Only a spanning forest leaves the task.
4. Exact verification: the sets of a candidate group are compared in blocks by a sparse product over shared grams (as
   64-bit hashes). Each representative gets its exact number of links, and a spanning forest of the exact links gives the
   groups.

Nodes and groups of more than BLOCK members are dealt out as pairs of blocks, so no task holds a whole large group; no
pair of documents becomes a row, and joins on nodes, groups and sets are salted. As the number of links is exact, a group of
m different texts costs m * m / 2 comparisons. Only documents that have a candidate are shuffled with their text.

Defined cases: null or wordless text has no grams and no links; null ids are left out; repeated rows (equal id and text)
count as copies; an id with several texts is one document, linked through any of them, with the links of the text that has
most; an empty table gives no rows; other input columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spread, cut, groups, parts_for, probable_members, strings, text_bytes, tidy, tidy_group, written
from .components import components
from .hashing import U64, byte_class, gram_hashes, lower_ascii, mix, runs, span_hashes, word_bounds

GRAM = 5
TREES, DEPTH = 16, 8
BLOCK = 512
_ALNUM = byte_class("alnum")


def prefix_depth(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair of similarity `threshold` meets in some tree with the wanted chance."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    return 1


def _factors(n: int) -> np.ndarray:
    """Odd multipliers from a counter."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def gram_sets(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The sorted different gram hashes of each row."""
    data = lower_ascii(data)
    starts, ends, before = word_bounds(data, offs, _ALNUM)
    words = span_hashes(data, starts, ends)
    grams = gram_hashes(words, GRAM)
    out = []
    for r in range(len(offs) - 1):
        a, b = int(before[r]), int(before[r + 1])
        if b - a >= GRAM:
            out.append(np.unique(grams[a : b - GRAM + 1]))
        else:
            out.append(gram_hashes(words[a:b], b - a) if b > a else np.zeros(0, U64))
    return out


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """One row of minima for each set; sets aren't empty."""
    x = np.concatenate(sets)
    edge = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), hashes), np.uint32)
    for i, f in enumerate(_factors(hashes)):
        out[:, i] = np.minimum.reduceat(((x * f) >> U64(32)).astype(np.uint32), edge)
    return out


SIGNED = "doc long, mark long, set_id binary, n int, sig binary"


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offs = strings(b.column(2))
        ids, marks = b.column(0).to_numpy(), b.column(1).to_numpy()
        for i, j in groups(offs, 4 << 20):
            sets = gram_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            at = [r for r, s in enumerate(sets) if len(s)]
            if at:
                sig = signatures([sets[r] for r in at], TREES * DEPTH)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j][at]), pa.array(marks[i:j][at]), pa.array([xxhash.xxh3_128_digest(sets[r].tobytes()) for r in at], pa.binary()), pa.array([len(sets[r]) for r in at], pa.int32()), pa.array([s.tobytes() for s in sig], pa.binary())],
                    names=["doc", "mark", "set_id", "n", "sig"],
                )


def sig_array(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def nodes(depth: int):
    """(node, tree, rep): the subtrie of each tree at the given depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = sig_array(b.column(1)).astype(U64)
            keys = []
            for t in range(TREES):
                h = np.full(len(sig), t + 1, U64)
                for d in range(depth):
                    h = mix(h * U64(0x9E3779B97F4A7C15) + sig[:, t * DEPTH + d])
                keys.append(h.view(np.int64))
            rep = b.column(0).to_numpy()
            tree = np.repeat(np.arange(TREES, dtype=np.int32), len(rep))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(tree), pa.array(np.tile(rep, TREES))], names=["node", "tree", "rep"])

    return run


def dealt(rows: DataFrame, key: str, count: str, member: str, buckets: int) -> DataFrame:
    """rows with (bucket, part, first, second): a group of at most BLOCK members is one part; a larger one is cut into
    blocks by hash, and each of its rows goes to every pair of blocks that has its own."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col(count) / BLOCK)).cast("int")
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other")).drop("other")
    part = F.xxhash64(key, "first", "second")
    return rows.withColumn("part", part).withColumn("bucket", F.pmod(part, F.lit(buckets)).cast("int")).drop(key, count)


class Forest:
    """Union-find over 0 .. n-1; the least member leads."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def join_matrix(self, linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        """All links of a boolean block: each of its connected parts is searched breadth-first, so a row or column is taken
        once and the unions are fewer than rows and columns, however many links there are."""
        new_row, new_column = linked.any(axis=1), np.ones(len(columns), bool)
        for i in range(len(rows)):
            if not new_row[i]:
                continue
            new_row[i] = False
            lead, front = int(rows[i]), np.array([i])
            while len(front):
                met = np.flatnonzero(linked[front].any(axis=0) & new_column)
                new_column[met] = False
                front = np.flatnonzero(linked[:, met].any(axis=1) & new_row)
                new_row[front] = False
                for k in [*columns[met], *rows[front]]:
                    self.join(lead, int(k))


def parts(table: pa.Table) -> Iterator[np.ndarray]:
    """Row numbers of each part of a bucket."""
    key = table["part"].to_numpy()
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(key) else np.zeros(0, np.int64)
    yield from np.split(order, edge[1:]) if len(key) else ()


def sides(mine: np.ndarray, own: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """The two blocks of a part, and whether they are one."""
    if first[mine[0]] == second[mine[0]]:
        return mine, mine, True
    return mine[own[mine] == first[mine[0]]], mine[own[mine] == second[mine[0]]], False


EDGES = "a long, b long"


def tries(sequences: np.ndarray, shortest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The order that sorts the sequences, and the nodes of their trie from the deepest level to `shortest`: for each level
    that has some (level, starts, ends, child): members [start, end) of the order share so long a prefix, and those with
    equal child share more."""
    order = np.lexsort(sequences.T[::-1])
    x = sequences[order]
    common = np.cumprod(x[1:] == x[:-1], axis=1).sum(axis=1)
    levels = []
    for level in np.unique(common)[::-1]:
        if level < shortest:
            break
        s, e = runs(common >= level)
        child = np.concatenate(([0], np.cumsum(common <= level)))
        levels.append((int(level), s, e + 1, child))
    return order, levels


def unite(forest: Forest, sig: np.ndarray, rows: np.ndarray, columns: np.ndarray, child: np.ndarray, least: float) -> None:
    """Joins members whose estimate reaches `least`, across the children of a node and not within a group that is one already."""
    lead = np.fromiter(map(forest.find, range(len(forest.up))), np.int64, len(forest.up))
    for at in range(0, len(rows), 64):
        r = rows[at : at + 64]
        for to in range(0, len(columns), 64):
            c = columns[to : to + 64]
            new = (lead[r][:, None] != lead[c][None, :]) & (child[r][:, None] != child[c][None, :])
            if new.any():
                same = (sig[r][:, None, :] == sig[c][None, :, :]).mean(axis=2, dtype=np.float32)
                forest.join_matrix(new & (same >= least), r, c)


def candidates(threshold: float, recall: float):
    least = threshold - 4 * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5
    shortest = prefix_depth(threshold, recall)

    def run(table: pa.Table) -> pa.Table:
        rep, tree, sigs = table["rep"].to_numpy(), table["tree"].to_numpy(), sig_array(table["sig"])
        own, first, second = (table[c].to_numpy() for c in ("own", "first", "second"))
        out: list[np.ndarray] = []
        for mine in parts(table):
            if len(mine) < 2:
                continue
            mine = mine[np.argsort(rep[mine], kind="stable")]
            t = int(tree[mine[0]])
            order, levels = tries(sigs[mine, t * DEPTH : (t + 1) * DEPTH], shortest)
            ranked, forest = sigs[mine][order], Forest(len(mine))  # members by their rank in the trie
            one = first[mine[0]] == second[mine[0]]
            left = np.ones(len(mine), bool) if one else own[mine][order] == first[mine[0]]
            for _, starts, ends, child in levels:
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    lead = forest.find(s)
                    if all(forest.find(k) == lead for k in range(s + 1, e)):
                        continue
                    members = np.arange(s, e)
                    unite(forest, ranked, members[left[s:e]], members if one else members[~left[s:e]], child, least)
            lead = np.array([forest.find(k) for k in range(len(mine))])
            rest = np.flatnonzero(lead != np.arange(len(mine)))
            if len(rest):
                out.append(np.stack([rep[mine[order[rest]]], rep[mine[order[lead[rest]]]]]))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.table([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return run


def send_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offs = strings(b.column(1))
        sets = []
        for i, j in groups(offs, 4 << 20):
            sets += [s.tobytes() for s in gram_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(sets, pa.binary())], names=["rep", "copies", "component", "grams"])


LINKED = "rep long, links long, lead long"


def shared_sizes(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products over the grams that both lists hold."""
    gx, gy = np.concatenate(x), np.concatenate(y)
    grams = np.intersect1d(gx, gy)
    out = np.zeros((len(x), len(y)), np.float32)
    rx, ry = np.repeat(np.arange(len(x)), [len(s) for s in x]), np.repeat(np.arange(len(y)), [len(s) for s in y])
    for at in range(0, len(grams), 8192):
        some = grams[at : at + 8192]

        def rows(g: np.ndarray, r: np.ndarray, n: int, some: np.ndarray = some) -> np.ndarray:
            k = np.minimum(np.searchsorted(some, g), len(some) - 1)
            ok = some[k] == g
            m = np.zeros((n, len(some)), np.float32)
            m[r[ok], k[ok]] = 1
            return m

        out += rows(gx, rx, len(x)) @ rows(gy, ry, len(y)).T
    return out


def verify(threshold: tuple[int, int]):
    """Exact: |x and y| * q >= |x or y| * p for a threshold of p / q."""
    p, q = threshold

    def run(table: pa.Table) -> pa.Table:
        rep, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
        own, first, second = (table[c].to_numpy() for c in ("own", "first", "second"))
        grams = [np.frombuffer(g, U64) for g in table["grams"].to_pylist()]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for mine in parts(table):
            mine = mine[np.argsort(rep[mine], kind="stable")]
            x, y, one = sides(mine, own, first, second)
            if not len(x) or not len(y) or len(mine) < 2:
                continue
            place = {int(k): i for i, k in enumerate(mine)}
            px, py = np.array([place[int(k)] for k in x]), np.array([place[int(k)] for k in y])
            nx, ny = (np.array([len(grams[k]) for k in side]) for side in (x, y))
            both = np.rint(shared_sizes([grams[k] for k in x], [grams[k] for k in y])).astype(np.int64)
            linked = both * q >= (nx[:, None] + ny[None, :] - both) * p
            if one:
                linked &= rep[x][:, None] != rep[y][None, :]
            links = np.zeros(len(mine), np.int64)
            np.add.at(links, px, linked @ copies[y])
            if not one:
                np.add.at(links, py, copies[x] @ linked)
            forest = Forest(len(mine))
            forest.join_matrix(linked, px, py)
            some = np.flatnonzero(links)
            if len(some):
                lead = np.array([forest.find(int(k)) for k in some])
                out.append((rep[mine[some]], links[some], rep[mine[lead]]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c) for c in cols], names=["rep", "links", "lead"])

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: tuple[int, int] = (4, 5), recall: float = 0.9995) -> DataFrame:
    """One row a document: the key, class_id (smallest id of its group of linked documents), copy_id (smallest id with an
    equal set of grams; its own for a document without grams), n_links (other documents at or above the threshold)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(body).alias("mark"), body.alias("body")).where("doc is not null")
    buckets = parts_for(docs, size=text_bytes(docs, text))
    share = threshold[0] / threshold[1]
    signed = written(rows.mapInArrow(tidy(scan), SIGNED))
    sets = signed.groupBy("set_id").agg(F.min(F.struct("doc", "mark")).alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    reps = written(sets.select("set_id", "rep.doc", "rep.mark", "copies", "sig").withColumnRenamed("doc", "rep"))
    met = cut(reps.select("rep", "sig").mapInArrow(tidy(nodes(prefix_depth(share, recall))), "node long, tree int, rep long"))
    shared = cut(met.groupBy("node").agg(F.count("*").alias("members")).where("members > 1"))
    in_nodes = dealt(Spread(shared, "node", "members").join(met, shared, "rep"), "node", "members", "rep", buckets)
    edges = in_nodes.join(reps.select("rep", "sig"), "rep").groupBy("bucket").applyInArrow(tidy_group(candidates(share, recall)), EDGES).distinct()
    found = cut(components(edges).select(F.col("node").alias("rep"), "component"))
    sizes = cut(found.groupBy("component").agg(F.count("*").alias("members")))
    may, _ = probable_members(rows.withColumnRenamed("doc", "rep"), found, ["rep"])
    texts = may.join(found, "rep").join(reps.select("rep", "mark", "copies"), ["rep", "mark"]).dropDuplicates(["rep", "mark"])
    grams = texts.select("rep", "body", "copies", "component").mapInArrow(tidy(send_sets), "rep long, copies long, component long, grams binary")
    parts_ = dealt(Spread(sizes, "component", "members").join(grams, sizes, "rep"), "component", "members", "rep", buckets)
    linked = cut(parts_.groupBy("bucket").applyInArrow(tidy_group(verify(threshold)), LINKED))
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(linked.select(F.col("rep").alias("a"), F.col("lead").alias("b"))).select(F.col("node").alias("rep"), "component")
    per_class = reps.select("set_id", "rep", "copies").join(links, "rep", "left").join(classes, "rep", "left")
    each = Spread(reps.select("set_id", "copies"), "set_id", "copies").join(signed.select("doc", "set_id"), per_class, "doc")
    each = each.select("doc", F.coalesce("component", "rep").alias("class_id"), F.col("rep").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    each = each.groupBy("doc").agg(F.min("class_id").alias("class_id"), F.min("copy_id").alias("copy_id"), F.max("n_links").alias("n_links"))
    return rows.select("doc").join(each, "doc", "left").select(F.col("doc").alias(key), F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("copy_id", "doc").alias("copy_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))

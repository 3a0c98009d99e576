"""Exact top-k search by inner product over KD-trees, one per shard.

Vectors become whole numbers floor(1024 x). A shard's tree splits at the median of the widest dimension down to leaves;
every node has the tight box of its points. For a query q no point of a box scores above sum(max(q_d lo_d, q_d hi_d)), and
a child's bound is at most its parent's. Traversal is best-first for a block of queries at a time: nodes are opened by
falling bound, leaves are scored with one matrix product for all queries that want them next, and a query stops when its
best open bound is below its k-th score so far.

Sums of products of 64-bit floats are exact below 2**53. Where a block and a tree may go beyond, bounds and scores carry
their rounding error, and only the points that may still count are scored again in whole numbers; one path serves all sizes.

Trees stay where they are and blocks of queries stream past them, one at a time. A block first visits HOPS shards in turn,
each hop with the k-th scores of all before it, and then takes those to all other shards, which return only what can still
matter. A task holds one tree and one block; results of a shard are k rows a query at most, ranked at last with a group limit.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null
id; vectors of another dimension than the query's don't compare; each query row has its own results, also where its id
repeats; a candidate with the query's own id is left out (so are its repetitions), other repeated rows count each; scores
beyond a long are held at its ends; an empty table gives no rows; other input columns are not carried.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, tidy, tidy_group, written

LEAF = 256
#: Every block of queries meets every shard, so both are as large as a task's memory allows: what is moved falls with both.
BLOCK = 8192
SHARD_BYTES = 16 << 20
HOPS = 3
_EXACT = 2.0**53
_LOWEST = -(1 << 63)


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors.astype(np.float64) * 1024.0)


class Tree:
    """Points in leaf order and, for each node, its box, its range of points and its children (-1: a leaf)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        lo, hi, span, kids = [], [], [], []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            mine = order[a:b]
            x = points[mine]
            me = len(lo)
            lo.append(x.min(axis=0))
            hi.append(x.max(axis=0))
            span.append((a, b))
            kids.append([-1, -1])
            if parent >= 0:
                kids[parent][side] = me
            if b - a > leaf and (hi[-1] > lo[-1]).any():
                d = int(np.argmax(hi[-1] - lo[-1]))
                m = (b - a) // 2
                order[a:b] = mine[np.argpartition(x[:, d], m)]
                stack += [(a, a + m, me, 0), (a + m, b, me, 1)]
        self.ids, self.points = ids[order], points[order]
        self.lo, self.hi = np.array(lo), np.array(hi)
        self.span, self.kids = np.array(span, np.int64), np.array(kids, np.int64)


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(payload: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(payload)) as f:
        return dict(f)


def best(q: np.ndarray, s: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query: highest score, then smallest id."""
    order = np.lexsort((v, ~s, q))
    q, s, v = q[order], s[order], v[order]
    at = np.arange(len(q)) - np.searchsorted(q, q)
    keep = at < k
    return q[keep], s[keep], v[keep]


def whole_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x and y in whole numbers, held at the ends of a long."""
    if len(x) and (np.abs(x) * np.abs(y)).sum(axis=1).max() < 2.0**62 and max(np.abs(x).max(), np.abs(y).max()) < 2.0**62:
        return (x.astype(np.int64) * y.astype(np.int64)).sum(axis=1)
    found = [sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for p, q in zip(x.tolist(), y.tolist(), strict=True)]
    return np.array([max(_LOWEST, min(-_LOWEST - 1, f)) for f in found], np.int64)


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, score, id) of each query's k best points that reach its score in `least` (whole numbers)."""
    z = np.zeros(0, np.int64)
    if not len(ids) or not len(tree.ids):
        return z, z, z
    with np.errstate(over="ignore", invalid="ignore"):
        return _search(tree, ids, queries, least, k)


def _search(tree: Tree, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    z = np.zeros(0, np.int64)
    up, down, size = np.maximum(queries, 0), np.minimum(queries, 0), np.abs(queries)
    far = np.maximum(np.abs(tree.lo), np.abs(tree.hi))
    exact = bool((size @ far[0]).max() < _EXACT)  # the root's box holds all others
    part = (queries.shape[1] + 4) * 2.0**-52

    def bounds(w: np.ndarray, n: int) -> np.ndarray:
        b = up[w] @ tree.hi[n] + down[w] @ tree.lo[n]
        return b if exact else np.nan_to_num(b + part * (size[w] @ far[n]), nan=np.inf, posinf=np.inf, neginf=-np.inf)

    # a long as a float that is not above it
    floor_of = lambda x: np.where(x == _LOWEST, -np.inf, np.nextafter(x.astype(np.float64), -np.inf))
    kth = floor_of(least)
    tops: tuple[np.ndarray, np.ndarray, np.ndarray] = (z, z, z)
    # the open nodes of all queries: (bound, query, node)
    who, node = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    bound = bounds(who, 0)
    while len(who):
        live = bound >= kth[who]
        bound, who, node = bound[live], who[live], node[live]
        inner = tree.kids[node, 0] >= 0
        if inner.any():  # open every inner node within reach: bounds alone, no point is scored
            w, n = who[inner], node[inner]
            kids = tree.kids[n]
            fresh_b, fresh_w, fresh_n = [], [], []
            for side in (0, 1):
                c = kids[:, side]
                order = np.argsort(c, kind="stable")
                edge = np.flatnonzero(np.concatenate(([True], c[order][1:] != c[order][:-1])))
                for some in np.split(order, edge[1:]):
                    fresh_b.append(bounds(w[some], c[some[0]]))
                    fresh_w.append(w[some])
                    fresh_n.append(c[some])
            bound, who, node = (np.concatenate([x[~inner], *f]) for x, f in ((bound, fresh_b), (who, fresh_w), (node, fresh_n)))
            continue
        if not len(who):
            break
        # each query scores its best open leaf
        order = np.lexsort((-bound, who))
        first = np.concatenate(([True], who[order][1:] != who[order][:-1]))
        now, rest = order[first], order[~first]
        by_leaf = now[np.argsort(node[now], kind="stable")]
        edge = np.flatnonzero(np.concatenate(([True], node[by_leaf][1:] != node[by_leaf][:-1])))
        q_new, s_new, v_new = [], [], []
        for some in np.split(by_leaf, edge[1:]):
            a, b = tree.span[node[some[0]]]
            w = who[some]
            points = tree.points[a:b]
            s = queries[w] @ points.T
            low = high = s
            if not exact:
                off = part * (size[w] @ np.abs(points).T)
                low, high = np.nan_to_num(s - off, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(s + off, nan=np.inf, posinf=np.inf, neginf=-np.inf)
            own = ids[w][:, None] == tree.ids[None, a:b]
            floor = kth[w]
            if b - a > k:  # of one leaf a query needs its k best and what may tie with the last of them
                floor = np.maximum(floor, np.partition(np.where(own, -np.inf, low), b - a - k, axis=1)[:, b - a - k])
            q, p = np.nonzero((high >= floor[:, None]) & ~own)
            q_new.append(w[q])
            s_new.append(s[q, p].astype(np.int64) if exact else whole_scores(queries[w[q]], points[p]))
            v_new.append(tree.ids[a:b][p])
        tops = best(*(np.concatenate([t, *n]) for t, n in zip(tops, (q_new, s_new, v_new), strict=True)), k)
        count = np.bincount(tops[0], minlength=len(ids))
        full = np.flatnonzero(count == k)
        last = np.cumsum(count)[full] - 1
        kth[full] = np.maximum(kth[full], floor_of(tops[1][last]))
        bound, who, node = bound[rest], who[rest], node[rest]
    keep = tops[1] >= least[tops[0]]
    return tops[0][keep], tops[1][keep], tops[2][keep]


def matrices(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, whole-number vectors) of each dimension."""
    table = table.combine_chunks()
    column = table["vector"].chunk(0) if table["vector"].num_chunks else pa.array([], pa.list_(pa.float32()))
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    start = column.offsets.to_numpy()[:-1] - (column.offsets[0].as_py() if len(column) else 0)
    ids = table["vec"].to_numpy()
    for d in np.unique(size):
        mine = np.flatnonzero(size == d)
        yield ids[mine], whole(flat[start[mine][:, None] + np.arange(d)])


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    x = F.col(vector)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select(F.col(key).cast("long").alias("vec"), x.alias("vector")).where(F.col("vec").isNotNull() & x.isNotNull() & (F.size("vector") > 0) & sound)


def build(table: pa.Table) -> pa.Table:
    shard = table["shard"][0].as_py()
    arrays: dict[str, np.ndarray] = {}
    for ids, points in matrices(table):
        order = np.argsort(ids, kind="stable")
        t = Tree(ids[order], points[order])
        arrays |= {f"{n}_{points.shape[1]}": getattr(t, n) for n in ("ids", "points", "lo", "hi", "span", "kids")}
    return pa.table([pa.array([shard], pa.int32()), pa.array([pack(**arrays)], pa.binary())], names=["shard", "payload"])


def block(table: pa.Table) -> pa.Table:
    """Queries of each dimension, numbered in the block, with their k-th scores so far and what they found (q, s, v)."""
    number = table["block"][0].as_py()
    none, first = np.zeros(0, np.int64), 0
    arrays: dict[str, np.ndarray] = {}
    for ids, points in matrices(table):
        d = points.shape[1]
        arrays |= {f"ids_{d}": ids, f"points_{d}": points, f"least_{d}": np.full(len(ids), _LOWEST), f"first_{d}": np.array([first])}
        arrays |= {f"q_{d}": none, f"s_{d}": none, f"v_{d}": none}
        first += len(ids)
    return pa.table([pa.array([number], pa.int32()), pa.array([pack(**arrays)], pa.binary())], names=["block", "payload"])


def trees(payload: bytes) -> dict[int, Tree]:
    held = unpack(payload)
    out = {}
    for name in held:
        if name.startswith("ids_"):
            d = name[4:]
            t = Tree.__new__(Tree)
            for n in ("ids", "points", "lo", "hi", "span", "kids"):
                setattr(t, n, held[f"{n}_{d}"])
            out[int(d)] = t
    return out


FOUND = "block int, q long, query long, vec long, score long"
BLOCKS = "block int, payload binary"


def rows_of(number: int, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    q, query, v, s = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(4))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), number, np.int32)), pa.array(q), pa.array(query), pa.array(v), pa.array(s)], names=[c.split()[0] for c in FOUND.split(", ")])


def visit(k: int, keep: bool):
    """Rows (shard, block, payload) by shard: its tree (block -1), then blocks of queries. With `keep` each block goes on
    with what it found and its k-th scores; else the rows that it found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[int, Tree] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                number, payload = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                if number < 0:
                    index = trees(payload)
                    continue
                held, found = unpack(payload), []
                for d in [n[4:] for n in held if n.startswith("ids_")]:
                    ids, least = held[f"ids_{d}"], held[f"least_{d}"]
                    if int(d) not in index:
                        continue
                    q, s, v = search(index[int(d)], ids, held[f"points_{d}"], least, k)
                    found.append((q + held[f"first_{d}"][0], ids[q], v, s))
                    if keep:
                        q, s, v = best(*(np.concatenate([held[f"{n}_{d}"], x]) for n, x in (("q", q), ("s", s), ("v", v))), k)
                        count = np.bincount(q, minlength=len(ids))
                        full = np.flatnonzero(count == k)
                        least[full] = s[np.cumsum(count)[full] - 1]
                        held |= {f"q_{d}": q, f"s_{d}": s, f"v_{d}": v, f"least_{d}": least}
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([pack(**held)], pa.binary())], names=["block", "payload"])
                elif found:
                    yield rows_of(number, found)

    return run


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What blocks found on their hops."""
    for b in batches:
        for i in range(b.num_rows):
            f = unpack(b.column(1)[i].as_py())
            yield rows_of(b.column(0)[i].as_py(), [(f[f"q_{d}"] + f[f"first_{d}"][0], f[f"ids_{d}"][f[f"q_{d}"]], f[f"v_{d}"], f[f"s_{d}"]) for d in [n[4:] for n in f if n.startswith("ids_")]])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id, score: for each row of queries its k best rows of vectors, but those with its id."""
    points, wanted = usable(vectors, key, vector), usable(queries, key, vector)
    shards = parts_for(vectors, SHARD_BYTES)
    index = written(points.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(tidy_group(build), "shard int, payload binary"))
    blocks = wanted.count() // BLOCK + 1
    # equal ids and vectors may fill a block beyond its size, so a row's number takes part in its place
    spread = F.pmod(F.xxhash64("vec", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    asked = written(wanted.withColumn("block", spread).groupBy("block").applyInArrow(tidy_group(block), BLOCKS))
    # a shard without rows has no tree, so shards that have one are numbered anew
    there = [r[0] for r in index.select("shard").orderBy("shard").collect()]  # one number a shard
    if not there:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shard = lambda hop: F.element_at(F.array(*[F.lit(x) for x in there]), F.pmod(F.col("block") + hop, F.lit(len(there))).cast("int") + 1)
    trees_ = index.select("shard", F.lit(-1).alias("block"), "payload")

    def met(sent: DataFrame, keep: bool) -> DataFrame:
        dealt = trees_.unionByName(sent.select("shard", "block", "payload")).repartition(len(there), "shard").sortWithinPartitions("shard", "block")
        return dealt.mapInArrow(tidy(visit(k, keep)), BLOCKS if keep else FOUND)

    hops = min(HOPS, len(there))
    for hop in range(hops):
        asked = written(met(asked.withColumn("shard", shard(hop)), True))
    found = asked.mapInArrow(tidy(opened), FOUND)
    if hops < len(there):
        rest = asked.withColumn("hop", F.explode(F.sequence(F.lit(hops), F.lit(len(there) - 1)))).withColumn("shard", shard(F.col("hop")))
        found = found.unionByName(met(rest, False))
    rank = F.row_number().over(Window.partitionBy("block", "q").orderBy(F.desc("score"), F.asc("vec")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("vec").alias("vec_id"), "score")

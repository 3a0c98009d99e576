"""Best-fit packing of tokenized documents into sequences of bounded length.

Tokens: where the vocabulary's file says that white space is dropped and words are cut as _CHUNKED lists, a text is cut at
spaces and line feeds; no token spans white space then, so the ids of the chunks, one after another, are the ids of the
text. Chunks repeat, so a worker keeps those it has seen with their ids (by their bytes, up to a stated number) and asks
the tokenizer for the rest. With any other vocabulary the tokenizer gets whole texts.

Packing is bulk-synchronous best fit. A round of pack():

1. Pieces without a place and gaps of open sequences are range-sorted together by falling size, gaps first where equal.
2. Successor sweep: in that order gaps are stacked, and a piece takes the top of the stack, which is the smallest gap that
   holds it. Every partition sweeps its own range as arrays; what it leaves over is a run of pieces that need a gap of a
   range before, and a run of gaps.
3. Conflicts are resolved by rank: the driver runs the same stack over one pair of counts a partition, and the i-th piece
   left over by a partition is joined with the gap of the rank that this gives it.
4. Pieces that found no gap open sequences, as many by rank in each as it is sure to hold.
5. Gaps are updated. A gap that holds the longest piece left several times enters as so many slots, so runs of small pieces
   need few rounds; gaps below the shortest piece left are closed.

A round takes the pieces that fit k times into a sequence, but not k+1 times, for k = 1 to FEW; below that those of more
than half of the longest length left, and sequences are opened only as the tokens left need them beyond all gaps. Rounds
repeat until all have a place: some 15, whatever the number of documents. Once all that is left, pieces and gaps, fits one
range, one task runs the rounds that remain, by the same rules and steps. No task holds more than its range, ties are spread by id, the driver sees a few
numbers a partition, and every round is kept in the shared folder.

Defined cases: null text is empty (one id: the end mark); longer documents are cut into full pieces and a rest; repeated
rows and null keys are packed each, and equal lengths come in the order of the rows; an empty table gives no rows. Of the
documents only the key is carried: one named like a result column of pieces() comes out as ``key_`` and its name. pack()
keeps all columns of its input; its own two win over clashing names.
"""

from __future__ import annotations

import functools
import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop_clashing, groups, held, strings, tidy
from .hashing import equal_spans, span_hashes, word_bounds

END = 0
# The settings of a vocabulary that cuts at white space, for which single chunks can be encoded.
_CHUNKED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_CHUNK = np.ones(256, bool)  # bytes of a chunk: all but space and line feed
_CHUNK[[0x20, 0x0A]] = False


@functools.cache
def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, n = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(n)
            n += 1
    return [letters[b] for b in range(256)]


class Encoder:
    """Token ids of whole texts. `most`: different chunks that it remembers at a time; of these those that came up in more
    than one batch stay when there are too many, as most chunks come up once."""

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.chunked = all(settings.get(k) == v for k, v in _CHUNKED.items())
        self.letters = _byte_letters()
        self.most = most
        self.chunks: dict[bytes, int] = {}  # a chunk: its number
        self.words: dict[str, list[int]] = {}
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)
        self.batches = np.zeros(1 << 16, np.uint16)  # that a chunk came up in, halved at times
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = self.count = 0

    def forget(self) -> None:
        """Leaves at most half as many chunks: the most frequent of those that came up again."""
        seen = self.batches[: self.count]
        least = max(2, int(np.partition(seen, self.count - self.most // 2)[self.count - self.most // 2]) if self.count > self.most // 2 else 2)
        keep = np.flatnonzero(seen >= least)
        if len(keep) > self.most // 2:
            keep = np.flatnonzero(seen > least)
        keys = list(self.chunks)  # in the order of their numbers
        keys = [keys[i] for i in keep]
        sizes, starts = self.sizes[keep], self.starts[keep]
        total = np.cumsum(sizes)
        used = int(total[-1]) if len(keep) else 0
        self.ids[:used] = self.ids[np.repeat(starts - (total - sizes), sizes) + np.arange(used)]
        self.batches[: len(keep)] = seen[keep] >> 1
        self.batches[len(keep) : self.count] = 0
        self.sizes[: len(keep)], self.starts[: len(keep)] = sizes, total - sizes
        self.used, self.count = used, len(keep)
        self.chunks = dict(zip(keys, range(len(keep)), strict=True))

    def word(self, word: str) -> list[int]:
        """Of letters below U+0100 in lower case, or one mark: lower case and normal form need no context here."""
        ids = self.words.get(word)
        if ids is None:
            ids = self.words[word] = [t.id for t in self.model.tokenize(word if word.isascii() else "".join([self.letters[b] for b in word.encode()]))]
        return ids

    def encode(self, chunk: str) -> list[int]:
        if max(chunk) < "\u0100":
            if chunk.isalpha():
                return self.word(chunk.lower())
            if chunk[-1] in ".," and chunk[:-1].isalpha():
                return self.word(chunk[:-1].lower()) + self.word(chunk[-1])
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def learn(self, chunks: list[bytes]) -> None:
        lists = [self.encode(c.decode()) for c in chunks]
        self.chunks.update(zip(chunks, range(self.count, self.count + len(chunks)), strict=True))
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        while self.count + len(sizes) > len(self.sizes):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.batches = np.concatenate([self.batches, np.zeros_like(self.batches)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.sizes[self.count : self.count + len(sizes)] = sizes
        self.starts[self.count : self.count + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.count += len(sizes)
        self.used += len(ids)

    def whole(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rows() by the tokenizer alone."""
        lists = [self.tokenizer.encode(data[a:z].tobytes().decode(), add_special_tokens=False).ids for a, z in itertools.pairwise(offs.tolist())]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes.sum())), np.concatenate(([0], np.cumsum(sizes)))

    hashes = staticmethod(span_hashes)

    def rows(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids before each row) of concatenated UTF-8 texts. Each different chunk is looked up once: those of
        equal hash are compared byte by byte, and one that differs from the first of its hash is looked up for itself."""
        if not self.chunked:
            return self.whole(data, offs)
        if self.count > self.most:
            self.forget()
        if len(self.words) > self.most // 3:
            self.words.clear()
        starts, ends, before = word_bounds(data, offs, _CHUNK)
        _, first, inverse = np.unique(self.hashes(data, starts, ends), return_index=True, return_inverse=True)
        lead, size = first[inverse], ends - starts
        same = size == size[lead]
        same[same] = equal_spans(data, starts[same], starts[lead[same]], size[same])
        if not same.all():
            odd = np.flatnonzero(~same)
            inverse[odd] = len(first) + np.arange(len(odd))
            first = np.concatenate([first, odd])
        raw = data.tobytes()
        keys = [raw[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if new := list(dict.fromkeys(k for k in keys if k not in self.chunks)):
            self.learn(new)
        at = list(map(self.chunks.__getitem__, keys))
        which = np.array(at, np.int64)
        self.batches[which] = np.minimum(self.batches[which], 60_000) + 1
        which = which[inverse]
        size = self.sizes[which]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(self.starts[which] - total[:-1], size) + np.arange(int(total[-1]))]
        return ids, total[before]


def encoder(path: str, most: int = 300_000) -> Encoder:
    """One for each vocabulary in a worker, kept between tasks."""
    return held(f"encoder {path}", lambda: Encoder(path, most))


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The key, piece, start, length, ids_crc32 (and ids): the documents' tokens, the end mark last, cut at the capacity."""
    kind = docs.select(F.col(key)).schema.fields[0].dataType
    own = f"key_{key}" if key.lower() in {"piece", "start", "length", "ids_crc32", "ids"} else key
    fields = [T.StructField(own, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            data, offs = strings(batch.column(1))
            for i, j in groups(offs):
                tokens, before = encode.rows(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                for r in range(j - i):
                    mine = np.append(tokens[before[r] : before[r + 1]], np.uint32(END)).astype("<u4")
                    for p, at in enumerate(range(0, len(mine), capacity)):
                        part = mine[at : at + capacity]
                        row.append(i + r)
                        piece.append(p)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            ids.append(part.astype(np.int32))
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=names)

    return docs.select(F.col(key).alias(own), F.col(text).cast("string").alias("__text__")).mapInArrow(tidy(run, f"encoder {vocabulary}"), T.StructType(fields))


#: Rows of a range that one task sweeps as arrays, about 40 bytes each in some ten arrays.
RANGE_ROWS = 200_000
#: Pieces of which a new sequence holds at most this many have a round for each such number.
FEW = 6
SWEPT = "part int, place long, piece long, length long, seq long, slot int, gap long"


def bracketed(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gaps, pieces) that a stack puts together: places in a sequence in which a gap is pushed and a piece pops one."""
    height = np.cumsum(np.where(is_gap, 1, -1))
    level = np.where(is_gap, height, height + 1)
    order = np.argsort(level, kind="stable")
    a, b = order[:-1], order[1:]
    hit = (level[a] == level[b]) & is_gap[a] & ~is_gap[b]  # of one level gaps and pieces take turns
    return a[hit], b[hit]


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range (part, is_gap, id, slot, size): pairs with no place; what is left over with its rank among its kind."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    part, is_gap, ids, slot, size = (c.to_numpy(zero_copy_only=False) for c in pa.Table.from_batches(got).combine_chunks().columns)
    gaps, pieces = bracketed(is_gap)
    free = np.ones(len(ids), bool)
    free[gaps] = free[pieces] = False
    lone_pieces, lone_gaps = np.flatnonzero(free & ~is_gap), np.flatnonzero(free & is_gap)
    p, g = np.concatenate([pieces, lone_pieces]), np.concatenate([gaps, lone_gaps])
    n, m, k = len(pieces), len(lone_pieces), len(lone_gaps)
    none = lambda n: pa.nulls(n, pa.int64())
    of_piece = lambda x: pa.chunked_array([pa.array(x[p].astype(np.int64)), none(k)]).combine_chunks()
    of_gap = lambda x, kind: pa.chunked_array([pa.array(x[gaps].astype(kind)), pa.nulls(m, pa.from_numpy_dtype(kind)), pa.array(x[lone_gaps].astype(kind))]).combine_chunks()
    rank = pa.chunked_array([none(n), pa.array(np.arange(m)), pa.array(np.arange(k))]).combine_chunks()
    out = pa.table([pa.array(np.full(n + m + k, part[0], np.int32)), rank, of_piece(ids), of_piece(size), of_gap(ids, np.int64), of_gap(slot, np.int32), of_gap(size, np.int64)], names=[c.split()[0] for c in SWEPT.split(", ")])
    yield from out.to_batches(max_chunksize=100_000)


def by_rank(counts: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]], int]:
    """The stack over what (part, pieces, gaps) leave over.

    Runs (part, first, other, top): its pieces from rank `first` on take the gaps of the other part, from rank `top` down;
    (part, first, number): pieces from that rank on find none, numbered over all parts; and how many find none.
    """
    stack: list[list[int]] = []
    runs, alone, number = [], [], 0
    for part, pieces, gaps in sorted(counts):
        done = 0
        while done < pieces and stack:
            other, left = stack[-1]
            take = min(left, pieces - done)
            runs.append((part, done, other, left - 1))
            done += take
            stack[-1][1] -= take
            if take == left:
                stack.pop()
        if done < pieces:
            alone.append((part, done, number))
            number += pieces - done
        if gaps:
            stack.append([part, gaps])
    return runs, alone, number


def routed(runs: list[tuple[int, int, int, int]], alone: list[tuple[int, int, int]]):
    """Pieces left over (part, place, piece, length) with the part and rank of their gap, or their number among those without."""
    table = np.array(sorted([(*r, 0) for r in runs] + [(p, first, n, 0, 1) for p, first, n in alone]), np.int64).reshape(-1, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, place = b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy()
            row = np.empty(len(part), np.int64)
            for x in np.unique(part):  # the last run of the part that begins at or before the place
                mine, here = np.flatnonzero(table[:, 0] == x), part == x
                row[here] = mine[np.searchsorted(table[mine, 1], place[here], "right") - 1]
            t = table[row]
            after = place - t[:, 1]
            lone = t[:, 4] == 1
            gap_part, gap_place = pa.array(t[:, 2].astype(np.int32), mask=lone), pa.array(t[:, 3] - after, mask=lone)
            yield pa.RecordBatch.from_arrays([gap_part, gap_place, b.column(2), b.column(3), pa.array(t[:, 2] + after, mask=~lone)], names=["part", "place", "piece", "length", "number"])

    return run


class Rules:
    """What a round takes, given the longest piece left."""

    def __init__(self, longest: int, capacity: int):
        self.each = capacity // longest  # pieces that a new sequence is sure to hold
        self.few = self.each <= FEW
        self.edge = capacity // (self.each + 1) if self.few else longest // 2  # of the pieces it takes those above

    def opening(self, alone: int, tokens_alone: int, lacking: int, found_some: bool, capacity: int) -> int:
        """Sequences to open for pieces that found no gap; lacking: the tokens left beyond all gaps."""
        most = -(-alone // self.each)
        if self.few:
            return most
        needed = -(-lacking // capacity)
        if needed <= 0 and not found_some:
            needed = -(-tokens_alone // capacity)
        return min(most, max(0, needed))


LAST = "piece long, sequence_id long, offset long"


def last_rounds(capacity: int, sequences: int, lacking: int):
    """All rounds left, where gaps and pieces (is_gap, id, size) fit one range: the same steps on arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        is_gap, ids, size = (c.to_numpy(zero_copy_only=False) for c in pa.Table.from_batches(got).combine_chunks().columns)
        seq, gap, piece, length = ids[is_gap], size[is_gap], ids[~is_gap], size[~is_gap]
        count, short = sequences, lacking
        while len(piece):
            rules = Rules(int(length.max()), capacity)
            now = np.flatnonzero(length > rules.edge)
            open_ = np.flatnonzero(gap >= length.min())
            seq, gap = seq[open_], gap[open_]
            slots = np.clip(gap // length.max(), 1, len(piece))
            owner = np.repeat(np.arange(len(gap)), slots)
            slot = np.arange(len(owner)) - np.repeat(np.cumsum(slots) - slots, slots)
            kind = np.concatenate([np.zeros(len(owner), bool), np.ones(len(now), bool)])
            order = np.lexsort((np.concatenate([slot, np.zeros(len(now), np.int64)]), np.concatenate([seq[owner], piece[now]]), kind, -np.concatenate([gap[owner], length[now]])))
            g, p = bracketed(~kind[order])
            g, p = owner[order[g]], now[order[p] - len(owner)]
            lone = np.ones(len(piece), bool)
            lone[p] = False
            alone = now[order[kind[order]] - len(owner)]
            alone = alone[lone[alone]]  # in falling order
            opening = rules.opening(len(alone), int(length[alone].sum()), short, len(p) > 0, capacity)
            new = alone[: opening * rules.each]
            seq, gap = np.concatenate([seq, count + np.arange(opening)]), np.concatenate([gap, np.full(opening, capacity)])
            into = np.concatenate([g, len(seq) - opening + np.arange(len(new)) // rules.each])
            who = np.concatenate([p, new])
            order = np.lexsort((who, into))
            into, who = into[order], who[order]
            total = np.cumsum(length[who])
            before = total - length[who]
            before -= before[np.searchsorted(into, into)]
            yield pa.RecordBatch.from_arrays([pa.array(piece[who]), pa.array(seq[into]), pa.array(capacity - gap[into] + before)], names=["piece", "sequence_id", "offset"])
            gap = gap - np.bincount(into, length[who], len(gap)).astype(np.int64)
            count, short = count + opening, short - opening * capacity
            lone[new] = False
            piece, length = piece[lone], length[lone]

    return run


def pack(found: DataFrame, capacity: int = 2048, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows with a length of 1 to `capacity`, with sequence_id and offset: sequences hold `capacity` at most and have no holes."""
    spark = found.sparkSession
    rows = cut(drop_clashing(found, ["sequence_id", "offset"]).withColumn("__piece__", F.monotonically_increasing_id()))
    number, lacking, longest, shortest = rows.agg(F.count("*"), F.sum("length"), F.max("length"), F.min("length")).first()
    if number and (shortest < 1 or longest > capacity):
        raise ValueError(f"lengths must lie in 1 to {capacity}")
    pieces = cut(rows.select(F.col("__piece__").alias("piece"), "length").coalesce(number // range_rows + 1))
    gaps = spark.createDataFrame([], "seq long, gap long")
    sequences = opened_gaps = 0
    rounds = []
    while number:
        if number + opened_gaps <= range_rows:
            both = gaps.select(F.lit(True).alias("is_gap"), F.col("seq").alias("id"), F.col("gap").alias("size")).unionByName(pieces.select(F.lit(False).alias("is_gap"), F.col("piece").alias("id"), F.col("length").alias("size")))
            rounds.append(cut(both.coalesce(1).mapInArrow(tidy(last_rounds(capacity, sequences, lacking)), LAST)))
            break
        rules = Rules(longest, capacity)
        each = rules.each
        now = pieces.where(F.col("length") > rules.edge)
        slots = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / longest), F.lit(number))).cast("int")
        offered = gaps.select(F.lit(True).alias("is_gap"), F.col("seq").alias("id"), F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"), F.col("gap").alias("size"))
        wanting = now.select(F.lit(False).alias("is_gap"), F.col("piece").alias("id"), F.lit(0).alias("slot"), F.col("length").alias("size"))
        order = [F.desc("size"), F.desc("is_gap"), F.asc("id"), F.asc("slot")]
        ranged = offered.unionByName(wanting).repartitionByRange((number + opened_gaps) // range_rows + 1, *order).sortWithinPartitions(*order)
        swept = cut(ranged.select(F.spark_partition_id().alias("part"), "is_gap", "id", "slot", "size").mapInArrow(tidy(sweep), SWEPT))
        count = lambda c: F.sum(F.when(c, 1).otherwise(0))
        lone, spare = F.col("seq").isNull(), F.col("piece").isNull()
        left = swept.groupBy("part").agg(count(lone), count(spare), count(~lone & ~spare), F.sum(F.when(lone, F.col("length")).otherwise(0))).collect()  # a row a partition
        runs, alone, rest = by_rank([(r[0], r[1], r[2]) for r in left])
        opening = rules.opening(rest, sum(r[4] for r in left), lacking, bool(runs) or any(r[3] for r in left), capacity)
        routes = swept.where(lone).select("part", "place", "piece", "length").mapInArrow(tidy(routed(runs, alone)), "part int, place long, piece long, length long, number long")
        taken = swept.where(spare).select("part", "place", "seq", "slot", "gap").join(routes.where("number is null").select("part", "place", "piece", "length"), ["part", "place"], "left")
        without = routes.where("number is not null")
        opened = without.where(F.col("number") < opening * each).select((F.floor(F.col("number") / each) + sequences).alias("seq"), (F.col("number") % each).cast("int").alias("slot"), F.lit(capacity).cast("long").alias("gap"), "piece", "length")
        columns = ["seq", "slot", "gap", "piece", "length"]
        every = swept.where(~lone & ~spare).select(columns).unionByName(taken.select(columns)).unionByName(opened)
        within = Window.partitionBy("seq").orderBy("slot")  # as many rows as a sequence holds pieces at most
        sums = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        filled = cut(every.withColumn("filled", F.coalesce(F.sum("length").over(sums), F.lit(0))).withColumn("last", F.lead("slot").over(within).isNull()))
        rounds.append(filled.where("piece is not null").select("piece", F.col("seq").alias("sequence_id"), (capacity - F.col("gap") + F.col("filled") - F.col("length")).alias("offset")))
        pieces = pieces.where(F.col("length") <= rules.edge)
        if rest > opening * each:
            pieces = pieces.unionByName(cut(without.where(F.col("number") >= opening * each).select("piece", "length")))
        sequences, lacking = sequences + opening, lacking - opening * capacity
        number, longest, shortest = pieces.agg(F.count("*"), F.max("length"), F.min("length")).first()
        gaps = filled.where("last").select("seq", (F.col("gap") - F.col("filled")).alias("gap")).where(F.col("gap") >= (shortest or capacity))
        opened_gaps = gaps.count() if number else 0
    places = functools.reduce(DataFrame.unionByName, rounds, spark.createDataFrame([], LAST)).withColumnRenamed("piece", "__piece__")
    return rows.join(places, "__piece__").drop("__piece__")

"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered from 0 in key order. Row number n goes to place p(n), where p is a keyed permutation of 0 .. N-1;
place p lies in shard p mod S at slot p div S. So shard sizes differ by one row at most (law ``rows``), slots have no
gaps, and both are computable from a row number alone, with no state but (N, S, seed).

Everything is DataFrame functions. Only the key and two numbers a row are shuffled, never the text: one range exchange
for the numbering. The driver gets one count per partition.

Defined cases: null keys come first in key order; rows with equal keys are ordered by text checksum, then size (rows
that agree in all three are interchangeable); a null text has size 1 and the checksum of empty text; an empty table
gives no rows; other input columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts_for

ROUNDS = 6
MULTIPLIERS = (1103515245, 1299709)  # odd, below 2**31: products of two 31-bit numbers stay within a long
MASK = (1 << 31) - 1


def half_bits(n: int) -> int:
    """Bits of each half of the Feistel block: the least even-width block that holds 0 .. n-1."""
    return max(1, ((max(2, n) - 1).bit_length() + 1) // 2)


def round_keys(seed: int) -> list[int]:
    keys, x = [], seed & MASK
    for _ in range(ROUNDS):
        x = (x * 48271 + 11) % MASK
        keys.append(x)
    return keys


def feistel(x: int, n: int, seed: int) -> int:
    """The place of row number x among n rows, on the driver."""
    b = half_bits(n)
    low = (1 << b) - 1
    while True:
        left, right = x >> b, x & low
        for key in round_keys(seed):
            t = ((right ^ key) * MULTIPLIERS[0]) & MASK
            t = ((t ^ (t >> 15)) * MULTIPLIERS[1]) & MASK
            left, right = right, left ^ ((t ^ (t >> 13)) & low)
        x = (left << b) | right
        if x < n:
            return x


def feistel_once(x: Column, b: int, seed: int) -> Column:
    """One pass over the whole block of 2*b bits. Nested higher-order calls bind each value once, so the expression stays small."""
    low = (1 << b) - 1

    def step(acc: Column, key: Column) -> Column:
        left, right = F.shiftright(acc, b), acc.bitwiseAND(F.lit(low))
        t = (right.bitwiseXOR(key) * F.lit(MULTIPLIERS[0])).bitwiseAND(F.lit(MASK))
        t = (t.bitwiseXOR(F.shiftright(t, 15)) * F.lit(MULTIPLIERS[1])).bitwiseAND(F.lit(MASK))
        mixed = t.bitwiseXOR(F.shiftright(t, 13)).bitwiseAND(F.lit(low))
        return F.shiftleft(right, b).bitwiseOR(left.bitwiseXOR(mixed))

    return F.aggregate(F.array(*[F.lit(k).cast("long") for k in round_keys(seed)]), x.cast("long"), step)


def permuted(x: Column, n: int, seed: int) -> Column:
    """Cycle walking: passes are repeated until the value is below n.

    The block is under four times n, so a walk of w steps has probability below (3/4)**w; the values walk along a
    bounded list of steps, and a walk past its end is an error rather than a wrong place.
    """
    b = half_bits(n)
    first = feistel_once(x, b, seed)
    steps = F.sequence(F.lit(1), F.lit(400))
    walked = F.aggregate(steps, first, lambda acc, _: F.when(acc < n, acc).otherwise(feistel_once(acc, b, seed)))
    place = F.when(first < n, first).otherwise(walked)
    return F.when(place < n, place).otherwise(F.raise_error(F.lit("a walk of 400 steps found no place")).cast("long"))


def numbered(rows: DataFrame, order: list[str], name: str, weight: str | None = None, before: str | None = None) -> DataFrame:
    """rows with a dense number from 0 in the order of the given columns, without a window over one partition.

    With a weight, also the sum of the weights of all rows before each one.
    """
    spark = rows.sparkSession
    parts = parts_for(rows)
    placed = (
        rows.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
        .withColumn("__part__", F.spark_partition_id())
        .withColumn("__at__", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed = cut(placed)
    heavy = F.sum(weight) if weight else F.lit(0).cast("long")
    counts = sorted(tuple(r) for r in placed.groupBy("__part__").agg(F.count("*"), heavy).collect())  # one row a partition
    base, total, sum_before = [], 0, 0
    for p, n, w in counts:
        base.append((p, total, sum_before))
        total += n
        sum_before += w or 0
    offsets = spark.createDataFrame(base, "__part__ int, __base__ long, __sum__ long")
    out = placed.join(F.broadcast(offsets), "__part__").withColumn(name, F.col("__base__") + F.col("__at__"))
    if weight and before:
        here = Window.partitionBy("__part__").orderBy("__at__").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(before, F.col("__sum__") + F.coalesce(F.sum(weight).over(here), F.lit(0)))
    return out.drop("__part__", "__at__", "__base__", "__sum__")


def shard(docs: DataFrame, shards: int = 8, seed: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns: the key, size (UTF-8 bytes plus 1), text_crc32, row_number, place, shard, slot."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    rows = numbered(rows, [key, "text_crc32", "size"], "row_number")
    total = rows.count()
    placed = rows.withColumn("place", permuted(F.col("row_number"), total, seed))
    return placed.withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", F.floor(F.col("place") / shards).cast("long"))

"""Shared plumbing of the operators: Arrow batches, checkpoints and sizing.

Conventions used by every operator of this subpackage:

* Input columns are named by parameters. Row-wise operators keep all input columns and add their own;
  an input column whose name equals a result column (compared without case) is left out, so the result wins.
* A null text counts as empty text. An empty table gives an empty result with the full schema.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker handles at a time; bounds its temporary arrays.
GROUP_BYTES = 2 << 20


#: What a Python worker keeps between tasks, by name; see tidy().
_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """A thing that is dear to make and stays in the worker for the next task of the same kind."""
    if name not in _HELD:
        _HELD[name] = make()
    return _HELD[name]


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def release() -> None:
    """Gives freed memory back to the system: workers are used again, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], holds: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run as a task that leaves little memory behind: at its start what tasks of other kinds kept goes, at its end what it freed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in [n for n in _HELD if n != holds]:
            del _HELD[name]
        try:
            yield from run(batches)
        finally:
            release()

    return task


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    def group(table: pa.Table) -> pa.Table:
        _HELD.clear()
        try:
            return run(table)
        finally:
            release()

    return group


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Where it names none, one of our own will do on one
    machine only: a folder of the driver is lost to a cluster's executors, so there that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="sparkmere-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Seconds between two collections of the driver's garbage, and when the last one was.
SWEEP_S = 20.0
_SWEPT = [time.monotonic()]


def _collect(sc: SparkContext) -> None:
    gc.collect()  # Python's handles hold the JVM's objects
    sc._jvm.System.gc()
    _SWEPT[0] = time.monotonic()


def sweep(spark: SparkSession) -> None:
    """Has the driver collect its garbage, every SWEEP_S seconds at most. Spark deletes shuffles, broadcasts and checkpoints
    that nothing reads any more only then; else a long run of many steps holds them all, and the driver's heap only grows."""
    sc = spark.sparkContext
    if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):  # in local mode the heap is the tasks' own
        watch(sc)
    if time.monotonic() - _SWEPT[0] >= SWEEP_S:
        _collect(sc)


#: The share of its limit by which the driver's heap may grow before its garbage is collected, seconds between two looks at
#: it, and seconds without a job after which nobody looks any more.
GROWN, LOOK_S, IDLE_S = 1 / 12, 1.0, 300.0
_WATCHES: dict[str, threading.Thread] = {}


def watch(sc: SparkContext) -> threading.Thread:
    """A thread that collects the driver's garbage whenever its heap has been enlarged, and every SWEEP_S seconds as long as
    it stays larger than it was: also within one long action, and in the lazy last one that the caller runs, where no step
    sweeps. Every job allocates several megabytes at once for each broadcast and map status, so the heap is soon enlarged to
    its limit for little that lives; only a full collection gives it back. The thread ends with the context, or some time
    after its last job; the next step starts another."""
    if (old := _WATCHES.get(sc.applicationId)) is not None and old.is_alive():
        return old
    thread = threading.Thread(target=_look, args=(sc,), name="sparkmere-heap", daemon=True)
    _WATCHES[sc.applicationId] = thread
    thread.start()
    return thread


def _look(sc: SparkContext) -> None:
    try:
        heap = sc._jvm.Runtime.getRuntime()
        most, now = GROWN * heap.maxMemory(), time.monotonic()
        least = held = heap.totalMemory()
        busy = asked = now
        while now - busy < IDLE_S:
            time.sleep(LOOK_S)
            now = time.monotonic()
            if now - asked >= IDLE_S / 10:
                busy, asked = now if sc.statusTracker().getActiveJobsIds() else busy, now
            size = heap.totalMemory()
            if size - held > most or (size - least > most and now - _SWEPT[0] >= SWEEP_S):  # what lived then may be garbage now
                _collect(sc)
                held = size = heap.totalMemory()
            least, held = min(least, size), min(held, size)
    except Exception:  # the context has ended
        pass


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder, with no lineage."""
    shared_dir(df.sparkSession)
    sweep(df.sparkSession)
    return df.checkpoint(eager=True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder is the cluster's to clean
        pass


def written(df: DataFrame) -> DataFrame:
    """Like cut(), as a compressed Parquet table: for wide rows. It goes when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sparkmere-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    sweep(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of df; for a scan, that of its files. 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def text_bytes(df: DataFrame, text: str) -> int:
    """The bytes of a column of texts, counted."""
    return df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def parts_for(df: DataFrame, bytes_each: int = 48 << 20, size: int | None = None) -> int:
    """How many hash buckets keep one bucket within an executor's memory: grows with the input, has no upper bound but
    sanity. size: the bytes of df, where they were counted."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1 << 20, (input_bytes(df) if size is None else size) // bytes_each + 1))


def drop_clashing(df: DataFrame, names: list[str]) -> DataFrame:
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings, nulls as empty; offsets has one entry more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    if len(column) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def groups(offs: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of about `most` bytes each, or of one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


def annotate(df: DataFrame, needs: list[str], adds: T.StructType, make: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]]) -> DataFrame:
    """df with columns added that make()(columns named in `needs`) computes for a batch of rows; no shuffle.

    `needs` are passed as arrays even where a result column takes their name over.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    names = [f.name for f in adds.fields]
    keep = drop_clashing(df, names)
    width = len(keep.columns)
    tags = [f"__c{i}__" for i in range(width + len(needs))]  # names with dots can't travel
    sent = df.select(*[F.col(f"`{c}`").alias(t) for c, t in zip([*keep.columns, *needs], tags, strict=True)])
    order = [keep.columns.index(c) if c in keep.columns else width + i for i, c in enumerate(needs)]
    sent = sent.select(*tags[:width], *[tags[i] for i in order if i >= width])
    order = [sent.columns.index(tags[i]) for i in order]
    schema = T.StructType([*sent.schema.fields[:width], *adds.fields])
    kinds = [to_arrow_type(f.dataType) for f in adds.fields]
    kept_names = tags[:width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                new = work([batch.column(i) for i in order])
                new = [a.cast(k) if a.type != k else a for a, k in zip(new, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(width)] + new, names=[*kept_names, *names])

    out = sent.mapInArrow(tidy(run), schema)
    return out.select(*[F.col(t).alias(c) for t, c in zip(kept_names, keep.columns, strict=True)], *names)


#: Longs of a bitmap that travel as one row.
BLOCK_WORDS = 1024


def probable_members(rows: DataFrame, ids: DataFrame, by: list[str], most_bits: int = 27) -> tuple[DataFrame, DataFrame]:
    """(rows that may be in ids, rows that surely aren't), by a bitmap over the hash of the columns `by`.

    The bitmap has some 16 bits an id, 2**22 at least and 2**most_bits at most, in blocks of BLOCK_WORDS longs a row, so it may
    be broadcast: as a row for each long it took the driver several times its bytes. With more ids it lets more rows through,
    and the exact join that follows still decides. `rows` is read twice.
    """
    bits = min(most_bits, max(22, (16 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64(*[F.col(c) for c in by]), F.lit(1 << bits))
    bit = F.expr("shiftleft(1L, cast(__place__ & 63 as int))")
    word = F.shiftright("__place__", 6)
    words = ids.select(place.alias("__place__")).groupBy(word.alias("__word__")).agg(F.bit_or(bit).alias("__bits__"))
    zeros = ids.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("__word__"), F.lit(0).cast("long").alias("__bits__"))
    words = words.unionByName(zeros).groupBy("__word__").agg(F.bit_or("__bits__").alias("__bits__"))
    each = F.sort_array(F.collect_list(F.struct("__word__", "__bits__")))
    blocks = words.groupBy(F.floor(F.col("__word__") / BLOCK_WORDS).alias("__block__")).agg(F.transform(each, lambda w: w["__bits__"]).alias("__bits__"))
    blocks = cut(blocks)
    tested = rows.withColumn("__place__", place).withColumn("__block__", F.floor(word / BLOCK_WORDS)).join(F.broadcast(blocks), "__block__")
    hit = F.get("__bits__", (word % BLOCK_WORDS).cast("int")).bitwiseAND(bit) != 0
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return tested.where(hit).select(*columns), tested.where(~hit).select(*columns)


#: Keys that are salted number at most this many, so a table of them may be broadcast.
BUSY_KEYS = 20_000
SALT = "__salt__"


class Spread:
    """Salts for keys that many rows share. counts: (key, n), kept already; n rows have that key.

    A key is busy with more than `per` rows, and per grows with the table, so at most BUSY_KEYS keys are. A busy key's rows
    are dealt to n / per salts by a hash of other columns; what is joined to them has one copy a salt.
    """

    def __init__(self, counts: DataFrame, key: str, n: str, per: int = 1000):
        self.key = key
        total, top = counts.agg(F.sum(n), F.max(n)).first()
        self.per = max(per, (total or 0) // BUSY_KEYS + 1)
        self.busy = None
        if (top or 0) > self.per:
            self.busy = cut(counts.where(F.col(n) > self.per).select(F.col(key).alias(key), F.ceil(F.col(n) / self.per).cast("int").alias("__salts__")))

    def salted(self, rows: DataFrame, *by: str, key: str | None = None) -> DataFrame:
        """The many rows of a key, with their salt."""
        if self.busy is None:
            return rows.withColumn(SALT, F.lit(0))
        busy = self.busy.withColumnRenamed(self.key, key) if key else self.busy
        salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("__salts__")).cast("int"), F.lit(0))
        return rows.join(F.broadcast(busy), key or self.key, "left").withColumn(SALT, salt).drop("__salts__")

    def copied(self, rows: DataFrame, key: str | None = None) -> DataFrame:
        """The one row of a key, once for each salt."""
        if self.busy is None:
            return rows.withColumn(SALT, F.lit(0))
        busy = self.busy.withColumnRenamed(self.key, key) if key else self.busy
        return rows.join(F.broadcast(busy), key or self.key, "left").withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce("__salts__", F.lit(1)) - 1))).drop("__salts__")

    def join(self, many: DataFrame, one: DataFrame, *by: str, how: str = "inner") -> DataFrame:
        if self.busy is None:
            return many.join(one, self.key, how)
        return self.salted(many, *by).join(self.copied(one), [self.key, SALT], how).drop(SALT)

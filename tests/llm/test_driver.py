"""What the driver holds."""

import gc
import time
from types import SimpleNamespace

from pyspark.sql import functions as F

from sparkmere.llm import common


def broadcast_bytes(plan):
    kind = plan.getClass().getSimpleName()
    if kind == "BroadcastExchangeExec":
        return [plan.metrics().apply("dataSize").value()]
    if kind == "AdaptiveSparkPlanExec":
        return broadcast_bytes(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return broadcast_bytes(plan.plan())
    below = plan.children()
    return [b for i in range(below.size()) for b in broadcast_bytes(below.apply(i))]


def test_the_bitmap_takes_the_driver_about_its_bytes(spark):
    n = 300_000
    rows = spark.range(2 * n).select("id", F.col("id").cast("string").alias("text"))
    may, clear = common.probable_members(rows, spark.range(n), ["id"])
    through = {r.id for r in may.collect()}
    assert through >= set(range(n)) and len(through) < 1.2 * n
    assert {r.id for r in clear.collect()} == set(range(2 * n)) - through
    sent = broadcast_bytes(may._jdf.queryExecution().executedPlan())
    assert len(sent) == 1 and sent[0] < 3 * (1 << 23) // 8  # of 2**23 bits


def test_ids_and_rows_that_are_null_or_none(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "id long, text string")
    may, clear = common.probable_members(rows, rows.where("id is null"), ["id"])
    assert "b" in {r.text for r in may.collect()} and may.count() + clear.count() == 3
    may, clear = common.probable_members(rows, rows.limit(0), ["id"])
    assert may.count() == 0 and clear.count() == 3
    assert common.probable_members(rows.limit(0), rows, ["id"])[0].count() == 0


def test_steps_give_the_drivers_garbage_back(spark, monkeypatch):
    def dropped():
        jvm = spark.sparkContext._jvm
        return jvm.java.lang.ref.WeakReference(jvm.java.lang.Object())

    monkeypatch.setattr(common, "SWEEP_S", 0.0)
    for step in (common.cut, common.written):
        gone = dropped()
        gc.collect()
        step(spark.range(3))
        step(spark.range(3))
        assert gone.get() is None
    monkeypatch.setattr(common, "SWEEP_S", 1e9)
    assert common.cut(spark.range(3)).count() == 3


def test_an_enlarged_heap_is_given_back_without_a_step(spark, monkeypatch):
    for name, value in (("SWEEP_S", 0.5), ("LOOK_S", 0.05), ("GROWN", 0.02)):
        monkeypatch.setattr(common, name, value)
    sc = spark.sparkContext
    heap = sc._jvm.Runtime.getRuntime()
    sc._jvm.System.gc()
    least, most = heap.totalMemory(), 0.02 * heap.maxMemory()
    thread = common.watch(sc)
    assert common.watch(sc) is thread
    kept = []
    while heap.totalMemory() - least < 4 * most and len(kept) < 60:
        kept.append(sc._jvm.java.nio.ByteBuffer.allocate(32 << 20))
    grown = heap.totalMemory()
    assert grown - least >= 4 * most
    kept.clear()
    gc.collect()
    until = time.monotonic() + 20
    while heap.totalMemory() > grown - 2 * most and time.monotonic() < until:
        time.sleep(0.05)
    assert heap.totalMemory() <= grown - 2 * most
    monkeypatch.setattr(common, "IDLE_S", 0.0)
    thread.join(10)
    assert not thread.is_alive() and common.watch(sc) is not thread


def test_steps_have_the_drivers_heap_watched_on_a_cluster(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "watch", seen.append)
    monkeypatch.setattr(common, "SWEEP_S", 1e9)
    for master in ("local[4]", "local", "yarn", "local-cluster[3,2,3000]", "spark://host:7077"):
        common.sweep(SimpleNamespace(sparkContext=SimpleNamespace(master=master)))
    assert [c.master for c in seen] == ["yarn", "local-cluster[3,2,3000]", "spark://host:7077"]

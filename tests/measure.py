"""What Spark's own counters say of a run."""

from __future__ import annotations


def _stages(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._gateway.new_array(sc._jvm.double, 0)
    listed = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s for s in (listed.apply(i) for i in range(listed.size()))}


def shuffled(spark, run) -> tuple[int, int]:
    """Rows and bytes that ``run`` writes to shuffles."""
    before = set(_stages(spark))
    run()
    new = [s for key, s in _stages(spark).items() if key not in before]
    return sum(s.shuffleWriteRecords() for s in new), sum(s.shuffleWriteBytes() for s in new)

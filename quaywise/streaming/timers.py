"""Streams that act when nothing happens: alerts at a due date, work that has stalled, announcements made once. State with timers and expiry.

Sessions need the state store of ``use_timers``. Time is event time: a timer fires once the watermark has passed it, whatever
the rows that move it there, and a restarted stream goes on with the timers of its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, time, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Days from the last free day at which a container's stage begins, and from a dispute's follow-up day.
FREE_TIME_STAGES = {"soon": -2, "today": 0, "late": 1}
DISPUTE_STAGES = {"overdue": 1}


def use_timers(spark: SparkSession) -> SparkSession:
    """``spark`` with the state store that timers need; set it where the session is made."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _millis(day: date) -> int:
    return int(datetime.combine(day, time(), timezone.utc).timestamp() * 1000)


class _Due(StatefulProcessor):
    """Timers at the beginning of each stage of the day that a key is due on; a new day replaces them, no day takes them away."""

    def __init__(self, stages: dict[str, int]):
        self.stages = stages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "due date, at timestamp")
        self.told = handle.getMapState("told", "stage string, due date", "told boolean")

    def _clear(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def _tell(self, key: tuple, due: date, now: int) -> Iterator[pd.DataFrame]:
        """The stage that has begun last, if it wasn't told for this day yet; those before it are passed over."""
        begun = [s for s, n in sorted(self.stages.items(), key=lambda x: x[1]) if _millis(due + timedelta(n)) <= now]
        if begun and not self.told.containsKey((begun[-1], due)):
            self.told.updateValue((begun[-1], due), (True,))
            yield pd.DataFrame([(*key, begun[-1], due)], columns=["key", "stage", "due"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values("at", kind="stable").iloc[-1]
        have = self.due.get() if self.due.exists() else None
        if have is not None and last["at"] < have[1]:
            return  # an older row than the one that counts
        self._clear()
        if pd.isna(last["due"]):
            self.due.update((None, last["at"].to_pydatetime()))
            return
        due = pd.Timestamp(last["due"]).date()
        self.due.update((due, last["at"].to_pydatetime()))
        now = max(timerValues.getCurrentWatermarkInMs(), 0)
        yield from self._tell(key, due, now)
        for n in self.stages.values():
            if _millis(due + timedelta(n)) > now:
                self.handle.registerTimer(_millis(due + timedelta(n)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.due.get()[0] if self.due.exists() else None
        if due is not None:
            yield from self._tell(key, due, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def due_alerts(rows: DataFrame, stages: dict[str, int], delay: str = "0 seconds") -> DataFrame:
    """key, stage, due: a row when a stage of the day that a key is due on begins, once for each stage and day.

    ``rows``: key (string), due (date; null: nothing is due any more), at (timestamp). The latest row of a key counts; a changed day begins again. Of stages that
    begin together, or had begun before the row came, the last one is told.
    """
    timed = rows.select("key", F.col("due").cast("date").alias("due"), "at").withWatermark("at", delay)
    return timed.groupBy("key").transformWithStateInPandas(_Due(stages), "key string, stage string, due date", "Append", "eventTime")


class _Stalled(StatefulProcessor):
    """A timer from the start of each piece of work; the end of the work takes it away."""

    def __init__(self, minutes: int, most: int):
        self.minutes, self.most = minutes, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.work = handle.getValueState("work", "started timestamp, requeues int")

    def _timer(self, at: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for r in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples():
            if r.ended:
                self.work.clear()
                self._timer(None)
            else:
                requeues = self.work.get()[1] if self.work.exists() else 0
                self.work.update((r.at.to_pydatetime(), requeues))
                self._timer(int(r.at.timestamp() * 1000) + self.minutes * 60_000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.work.exists():
            return
        started, requeues = self.work.get()
        if requeues >= self.most:
            self.work.clear()
            yield pd.DataFrame([(*key, "error", requeues)], columns=["key", "action", "requeues"])
            return
        self.work.update((started, requeues + 1))
        self._timer(expiredTimerInfo.getExpiryTimeInMs() + self.minutes * 60_000)
        yield pd.DataFrame([(*key, "requeue", requeues + 1)], columns=["key", "action", "requeues"])

    def close(self) -> None:
        pass


def stalled_work(rows: DataFrame, minutes: int = 30, most: int = 3, delay: str = "0 seconds") -> DataFrame:
    """key, action, requeues: work that hasn't ended ``minutes`` after its start is requeued, up to ``most`` times, each with as long to end, then failed.

    ``rows``: key (string), ended (boolean), at (timestamp).
    """
    timed = rows.select("key", "ended", "at").withWatermark("at", delay)
    return timed.groupBy("key").transformWithStateInPandas(_Stalled(minutes, most), "key string, action string, requeues int", "Append", "eventTime")


def outbox(root: str, key: list[str]):
    """A ``foreachBatch`` writer that puts each ``key`` (an event and its receiver, an organisation and its local day) into the table at ``root`` once.

    What the table holds is claimed: a batch that is replayed, by a restart or by a stream begun anew, adds only what isn't there. One
    stream writes to an outbox. Receivers read the table; a row is there as a whole or not at all.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(key).withColumn("batch", F.lit(batch_id).cast("long"))
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(path):
            fresh = fresh.join(spark.read.schema(fresh.schema).parquet(root).select(*key), key, "left_anti")
        fresh.write.mode("append").parquet(root)

    return write

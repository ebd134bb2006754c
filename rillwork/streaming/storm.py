"""Rain gauges as a stream: hourly depths under a watermark, and their running runoff per gauge."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RUNOFF = "gauge long, ts timestamp, mm double, cum_mm double, runoff_mm double"
#: The state store that holds maps and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def hourly(readings: DataFrame, late: str = "1 hour") -> DataFrame:
    """(gauge, hour, mm) of windows of one hour; readings later than ``late`` are dropped."""
    w = F.window("ts", "60 minutes")
    return readings.withWatermark("ts", late).groupBy(w, "gauge").agg(F.sum("mm").alias("mm")).select("gauge", F.col("window.start").alias("hour"), "mm")


class GaugeRunoff(StatefulProcessor):
    """Holds a gauge's readings until the watermark has passed them, then adds them up in the order of time.

    State: the depth so far, and the readings that wait, each kept by its millisecond and written once. A timer at
    the next millisecond takes them out again, so a batch touches what comes and what goes, not all that waits.
    """

    def __init__(self, cn: float):
        self.s = 25400.0 / cn - 254.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.depth = handle.getValueState("depth", "mm double")
        self.waiting = handle.getMapState("waiting", "ms long", "us array<long>, mm array<double>")

    def runoff(self, p: float) -> float:
        return 0.0 if p <= 0.2 * self.s else (p - 0.2 * self.s) ** 2 / (p + 0.8 * self.s)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            us = batch["ts"].astype("datetime64[us]").astype("int64")
            known = pd.DataFrame({"ms": us // 1000, "us": us, "mm": batch["mm"].astype(float)})
            for ms, own in known[known["ms"] >= mark].groupby("ms"):  # what the watermark has passed is too late
                at = (int(ms),)
                old = self.waiting.getValue(at) if self.waiting.containsKey(at) else None
                times, depths = (list(old[0]), list(old[1])) if old else ([], [])
                self.waiting.updateValue(at, (times + own["us"].tolist(), depths + own["mm"].tolist()))
                if not old:
                    self.handle.registerTimer(int(ms) + 1)
        yield pd.DataFrame(columns=[c.split()[0] for c in RUNOFF.split(", ")]).astype({"gauge": "int64", "ts": "datetime64[us]", "mm": "float64", "cum_mm": "float64", "runoff_mm": "float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Timers come in the order of time."""
        at = (expiredTimerInfo.getExpiryTimeInMs() - 1,)
        if not self.waiting.containsKey(at):
            return
        times, depths = self.waiting.getValue(at)
        self.waiting.removeKey(at)
        total, out = (self.depth.get()[0] if self.depth.exists() else 0.0), []
        for us, mm in sorted(zip(times, depths, strict=True)):
            before, total = self.runoff(total), total + max(0.0, mm)
            out.append((key[0], pd.Timestamp(us, unit="us"), mm, total, max(0.0, self.runoff(total) - before)))
        self.depth.update((total,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RUNOFF.split(", ")])

    def close(self) -> None:
        pass


def running_runoff(readings: DataFrame, cn: float = 61.0, late: str = "1 hour") -> DataFrame:
    """Each reading (gauge, ts, mm) with the gauge's depth so far and the SCS runoff it adds, in the order of time.

    A reading waits in the state until the watermark has passed it, so what arrives out of order within ``late`` comes
    out as if it had arrived in order; what is later than that is dropped. A depth below 0 adds nothing, a reading
    without a time or a depth is none. The session gets the state store that this needs.
    """
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    marked = readings.where("gauge is not null and ts is not null and mm is not null").withWatermark("ts", late)
    return marked.groupBy("gauge").transformWithStateInPandas(GaugeRunoff(cn), RUNOFF, "append", "eventTime")

"""Per-station tumbling windows as a keyed streaming operator, and an idempotent sink.

Spark's own watermark is one bound for all keys: a fast station would make a slow one late. Here every station keeps its
own newest timestamp and bound in state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.archive import Archive
from ..sources import schemas

OUT = "station string, sensor int, timestamp long, window_ms long, mean double, min double, max double, count long, regime int"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


class StationWindows(StatefulProcessor):
    """State per station: newest timestamp, bound of what an idle flush has closed, and the open windows' sums."""

    def __init__(self, window_ms: int, lateness_ms: int, idle_ms: int | None = None):
        self.window_ms, self.lateness_ms, self.idle_ms = window_ms, lateness_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("station", "data string")

    def _load(self) -> dict:
        if self.state.exists():
            return json.loads(self.state.get()[0])
        return {"newest": None, "flushed": None, "open": {}}

    def _emit(self, key, s: dict, starts: list[int]) -> Iterator[pd.DataFrame]:
        rows = []
        for start in sorted(starts):
            w = s["open"].pop(str(start))
            best = min((-n, int(r)) for r, n in w["regimes"].items())[1] if w["regimes"] else None
            for sensor, (n, total, lo, hi) in sorted(w["sensors"].items(), key=lambda x: int(x[0])):
                rows.append((key[0], int(sensor), start, self.window_ms, total / n, lo, hi, n, best))
        if rows:
            out = pd.DataFrame(rows, columns=_COLUMNS)
            out["regime"] = out["regime"].astype("Int32")
            yield out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = self._load()
        new = pd.concat(list(rows)).sort_values(["seq"], kind="stable")
        ts = new["timestamp"].to_numpy(np.int64)
        lowest = np.iinfo(np.int64).min // 4
        newest = lowest if s["newest"] is None else s["newest"]
        # newest timestamp before each row; a late row never raises it
        before = np.maximum.accumulate(np.concatenate([[newest], ts]))[:-1]
        start = ts - ts % self.window_ms
        late = (start + self.window_ms <= before - self.lateness_ms) | (start <= (lowest if s["flushed"] is None else s["flushed"]))
        for at, values, regime in zip(start[~late].tolist(), new["values"][~late], new["regime"][~late]):
            w = s["open"].setdefault(str(at), {"sensors": {}, "regimes": {}})
            if regime is not None and not pd.isna(regime):
                r = str(int(regime))
                w["regimes"][r] = w["regimes"].get(r, 0) + 1
            for i, v in enumerate(values):
                if v is not None and np.isfinite(v):
                    n, total, lo, hi = w["sensors"].get(str(i), (0, 0.0, v, v))
                    w["sensors"][str(i)] = (n + 1, total + float(v), min(lo, float(v)), max(hi, float(v)))
        s["newest"] = int(max(newest, ts[~late].max(initial=lowest)))
        closed = [int(a) for a in s["open"] if int(a) + self.window_ms <= s["newest"] - self.lateness_ms]
        yield from self._emit(key, s, closed)
        self.state.update((json.dumps(s),))
        self._arm(timerValues, s)

    def _arm(self, timerValues, s: dict) -> None:
        """One timer a station: the moment at which it has been silent for idle_ms. Events stamped ahead of the clock
        put it off, so it never fires before the windows may be closed."""
        if self.idle_ms is None:
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if s["open"]:
            self.handle.registerTimer(max(timerValues.getCurrentProcessingTimeInMs(), s["newest"]) + self.idle_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        now = timerValues.getCurrentProcessingTimeInMs()
        if s["newest"] is not None and s["open"] and now - s["newest"] > self.idle_ms:
            starts = [int(a) for a in s["open"]]
            s["flushed"] = max([*starts, *([s["flushed"]] if s["flushed"] is not None else [])])
            yield from self._emit(key, s, starts)
            self.state.update((json.dumps(s),))
        else:
            self._arm(timerValues, s)

    def close(self) -> None:
        pass


def window_stream(events: DataFrame, window_ms: int, lateness_ms: int, idle_ms: int | None = None) -> DataFrame:
    """Closed windows of a stream of (station, timestamp, values, regime, seq); seq is the arrival order. With idle_ms a
    station that falls silent by the wall clock is flushed by a timer; replays of old data must leave it out."""
    return events.groupBy("station").transformWithStateInPandas(
        statefulProcessor=StationWindows(window_ms, lateness_ms, idle_ms), outputStructType=OUT, outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime"
    )


def ingest_stream(spark: SparkSession, path: str, window_ms: int, lateness_ms: int, idle_ms: int | None = None) -> DataFrame:
    """Closed windows of a folder of raw messages. What isn't a valid message is left out here; a query of its own over
    streams.read_stream keeps it. Files of a batch are taken by modification time, lines of a file as they are read."""
    arrived = F.unix_micros("_metadata.file_modification_time")
    lines = spark.readStream.format("text").load(path).select("value", arrived.alias("seq"))
    good = schemas.decode(lines, "raw").where("ok")
    return window_stream(good.select("m.station", "m.timestamp", "m.values", F.col("m.regime").cast("int").alias("regime"), "seq"), window_ms, lateness_ms, idle_ms)


def dedup_stream(rows: DataFrame, key: list[str], event_time: str, within: str = "2 minutes") -> DataFrame:
    """Drops a message whose key was seen within the span."""
    return rows.withWatermark(event_time, within).dropDuplicatesWithinWatermark(key)


def archive_sink(archive: Archive, order: list[str] | None = None):
    """For foreachBatch: writes what the archive lacks. A batch that runs again after a failure writes nothing twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        archive.upsert(batch, order or ["window_ms", "count"])

    return write


def upsert_stream(stats: DataFrame, archive: Archive, checkpoint: str, trigger: dict | None = None):
    """Starts the query that keeps the archive current; its checkpoint is committed after each batch is written."""
    return stats.writeStream.foreachBatch(archive_sink(archive)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def counters(rows: DataFrame, name: str) -> DataFrame:
    """Adds an observation of accepted rows and their newest timestamp, readable from query progress."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), F.max("timestamp").alias("newest"))

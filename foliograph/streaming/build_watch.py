"""A watch over index builds: heartbeats in, builds that fell silent out, each once.

The state is one row a version: its last heartbeat, and whether it is still
building.  A timer in event time stands ``limit`` after the last heartbeat; a
heartbeat moves it, an end takes it away.  It goes off when the stream's
watermark, which all builds' heartbeats move, has passed it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from foliograph.operators import builds
from foliograph.sources.commits import Log

SILENT = "version_id string, last_beat timestamp"


class Watch(StatefulProcessor):
    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "beat long, building boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        beat, building = self.state.get() if self.state.exists() else (0, True)
        for batch in rows:
            beat = max(beat, int(batch["at"].max().timestamp() * 1000))
            building = building and not batch["status"].isin(["ready", "failed"]).any()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if building:
            self.handle.registerTimer(beat + self.limit)
        self.state.update((beat, bool(building)))
        yield pd.DataFrame({"version_id": [], "last_beat": []}).astype({"version_id": "object", "last_beat": "datetime64[ns]"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        beat, building = self.state.get()
        if building:
            self.state.update((beat, False))
            yield pd.DataFrame({"version_id": [key[0]], "last_beat": [pd.Timestamp(beat, unit="ms")]})

    def close(self) -> None:
        pass


def silent(beats: DataFrame, limit: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Versions (version_id, last_beat) that sent no heartbeat for ``limit``; ``beats`` is a stream of version_id, status, at."""
    ms = int(pd.Timedelta(limit).total_seconds() * 1000)
    rows = beats.select("version_id", "status", "at").withWatermark("at", late)
    return rows.groupBy("version_id").transformWithStateInPandas(statefulProcessor=Watch(ms), outputStructType=SILENT, outputMode="append", timeMode="eventTime")


def fail_silent(log: Log, beats: DataFrame, checkpoint: str, limit: str = "10 minutes", late: str = "1 minute", now: str | None = None) -> StreamingQuery:
    """Fail the silent builds in the ledger; a micro-batch that is repeated finds them failed already.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """

    def batch(found: DataFrame, number: int) -> None:
        builds.fail_versions(log, found.select("version_id"), now)

    return silent(beats, limit, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def beats_of(versions: DataFrame) -> DataFrame:
    """Rows of the ledger's versions as heartbeats."""
    return versions.select("version_id", "status", F.to_timestamp("updated_at").alias("at"))

"""Job states as a stream (an extension): job events in, the latest state of each job out.

The state keeps one row a job; update mode sends only jobs that changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from foliograph.operators.ledger import job_states


def fold(events: DataFrame) -> DataFrame:
    return job_states(events)


def start(events: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return fold(events).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

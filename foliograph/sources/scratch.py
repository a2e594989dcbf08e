"""A folder for what a query writes on its way: below ``spark.checkpoint.dir``, removed when the driver ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

from foliograph.sources.commits import hadoop


def shared(spark: SparkSession) -> bool:
    """Whether there is a folder that driver and executors share."""
    return bool(spark.conf.get("spark.checkpoint.dir", None)) or spark.sparkContext.master.startswith("local")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; only a local master may go without one."""
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        if not shared(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        home = tempfile.mkdtemp(prefix="foliograph-")
    path = f"{home.rstrip('/')}/foliograph-ledger/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            fs, p = hadoop(spark, path)
            fs.delete(p, True)
        except Exception:  # the session may be gone already
            pass

    atexit.register(remove)
    return path

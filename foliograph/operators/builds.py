"""Index versions as a state machine over the ledger's commits.

A version is building, then ready or failed.  Each step of a build writes the
version's row anew, which is its heartbeat; the number of that commit is the
build's fence.  A build that fell silent is failed by whoever looks, once; if
it wakes up, its fence no longer holds and it cannot become the active index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.operators.mutations import LedgerProblem, mark, moment
from foliograph.schemas import ANALYZER_VERSION
from foliograph.sources.commits import VERSION, Log, Transaction

PROVIDER = "bm25"
STALE, LOST = "index_build_stale", "index_build_lost"


@dataclass
class Build:
    log: Log
    version_id: str
    fence: int = 0

    def _own(self, own: Transaction) -> DataFrame:
        """The version's row, if this build still holds it."""
        row = own.current("index_versions").where((F.col("version_id") == self.version_id) & (F.col("status") == "building") & (F.col(VERSION) == self.fence))
        if row.isEmpty():
            raise LedgerProblem(LOST, self.version_id)
        return row

    def _write(self, changed, also=None) -> None:
        def work(own: Transaction) -> None:
            own.add("index_versions", changed(self._own(own)), guards=("index_versions",))
            if also:
                also(own)

        self.fence = self.log.run(work).version

    def beat(self, now: str | None = None) -> None:
        self._write(lambda row: row.withColumn("updated_at", moment(now)))

    def ready(self, documents: int, now: str | None = None) -> None:
        """Ready and active, in one commit: the old version is active up to it."""
        at = moment(now)
        active = self.log.spark.range(1).select(F.lit(PROVIDER).alias("provider"), F.lit(self.version_id).alias("version_id"), at.alias("updated_at"))
        made = lambda row: row.withColumn("status", F.lit("ready")).withColumn("document_count", F.lit(documents)).withColumns({c: at for c in ("build_finished_at", "activated_at", "updated_at")})
        self._write(made, lambda own: own.add("index_active", active))

    def failed(self, code: str, message: str, now: str | None = None) -> None:
        self.log.run(lambda own: _fail(own, self._own(own), code, message, now))


def start(log: Log, version_id: str, directory: str, now: str | None = None) -> Build:
    """A new version, building; an id that is there already is an error."""
    at, none = moment(now), F.lit(None).cast("string")

    def work(own: Transaction) -> None:
        if not own.current("index_versions").where(F.col("version_id") == version_id).isEmpty():
            raise LedgerProblem("index_version_exists", version_id)
        row = log.spark.range(1).select(
            F.lit(version_id).alias("version_id"), F.lit(PROVIDER).alias("provider"), F.lit(ANALYZER_VERSION).alias("analyzer_version"), F.lit("building").alias("status"), F.lit(directory).alias("index_directory"),
            F.lit(0).alias("document_count"), at.alias("build_started_at"), none.alias("build_finished_at"), none.alias("activated_at"), none.alias("error_id"), at.alias("created_at"), at.alias("updated_at"),
        )
        own.add("index_versions", row, guards=("index_versions",))

    return Build(log, version_id, log.run(work).version)


def _fail(own: Transaction, rows: DataFrame, code: str, message: str, now: str | None) -> int:
    """Versions that end here, each with an error of its own."""
    at = moment(now)
    rows = rows.withColumn("error_id", mark("version_id", F.lit(code)))
    none = F.lit(None).cast("string")
    own.add("errors", rows.select("error_id", F.lit(code).alias("code"), F.lit(message).alias("message"), F.lit("index").alias("stage"), F.lit(True).alias("retryable"), none.alias("details"), mark(F.lit("correlation"), "error_id").alias("correlation_id"), at.alias("created_at")))
    made = rows.withColumn("status", F.lit("failed")).withColumn("build_finished_at", at).withColumn("updated_at", at)
    return own.add("index_versions", made, guards=("index_versions",))


def fail_stale(log: Log, before: str, now: str | None = None) -> Transaction:
    """Fail the builds whose last heartbeat is older than ``before``; of two sessions that try, one finds them.  The active index stays."""
    return log.run(lambda own: _fail(own, own.current("index_versions").where((F.col("status") == "building") & (F.col("updated_at") < before)), STALE, "the build was interrupted", now))


def fail_versions(log: Log, versions: DataFrame, now: str | None = None) -> Transaction:
    """Fail these builds (version_id), as far as they are building still."""
    return log.run(lambda own: _fail(own, own.current("index_versions").where("status = 'building'").join(versions, "version_id", "left_semi"), STALE, "the build was interrupted", now))


def active(log: Log) -> DataFrame:
    """The active version's row; none where a version was never ready."""
    return log.current("index_versions").drop(VERSION).join(log.current("index_active").select("provider", "version_id"), ["provider", "version_id"], "left_semi")


def version(log: Log, version_id: str) -> DataFrame:
    """A version with the error it ended with; of versions and errors only the parts that may hold them are read."""
    state = log.state()
    rows = log.lookup("index_versions", "version_id", version_id, state)
    newest = rows.groupBy("version_id").agg(F.max_by(F.struct(*rows.columns), F.struct(VERSION, "_number")).alias("row")).select("row.*").drop(VERSION, "_number")
    found = newest.select("error_id").first()
    told = ["error_id", F.col("code").alias("error_code"), F.col("message").alias("error_message"), "correlation_id"]
    errors = log.lookup("errors", "error_id", found[0], state) if found and found[0] else log.read("errors", state, only=[])
    return newest.join(errors.select(*told), "error_id", "left")


def error(log: Log, correlation_id: str) -> DataFrame:
    return log.lookup("errors", "correlation_id", correlation_id)

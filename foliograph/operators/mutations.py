"""What changes the ledger: jobs and their events, errors, leases and results, deletion.

Each function is one commit of :mod:`foliograph.sources.commits`, over as many
rows as there are.  A page's lease is its row with the status analysis_pending;
the number of the commit that wrote it is the fence: a success or a failure is
taken only while the page's newest row is still that one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text as X
from foliograph.operators import ledger
from foliograph.schemas import SCHEMA_VERSION
from foliograph.sources.commits import NUMBER, VERSION, Conflict, Log, Transaction, hadoop

#: Codes of failures that leave no row behind.
NOT_KEPT = ("page_analysis_already_running", "page_not_eligible_for_analysis", "stale_page_analysis_lease_lost")
LEASE_LOST = "stale_page_analysis_lease_lost"
INTERRUPTED = "job_interrupted"
CREATED = "任务已创建，等待后续执行。"


class LedgerProblem(RuntimeError):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


def moment(now: str | None) -> Column:
    """One time for all that a call writes: ids that are made of it are the same in each of its tables."""
    return F.lit(now or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ"))


def mark(*parts) -> Column:
    """An id that follows from what it names, so that a repeated task gives the same."""
    cells = [F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("\x00")) for p in parts]
    return F.left(F.sha2(F.concat_ws("\x1f", *cells), 256), F.lit(32))


# --- events, errors, jobs


def append_events(log: Log, events: DataFrame, writer: str, batch: int) -> Transaction | None:
    """Events of one batch; a batch that comes again adds nothing.  Their numbers are dense over all batches."""
    return log.run(lambda own: own.add("job_events", events), writer, batch)


def record_errors(log: Log, errors: DataFrame, writer: str | None = None, batch: int | None = None) -> Transaction | None:
    return log.run(lambda own: own.add("errors", errors), writer, batch)


def _event(rows: DataFrame, kind: str, message, progress, at: Column) -> DataFrame:
    return rows.select(mark("job_id", F.lit(kind), message, progress, at).alias("event_id"), "job_id", F.lit(kind).alias("event_type"), message.alias("message"), progress.cast("long").alias("progress"), at.alias("created_at"))


def create_jobs(log: Log, jobs: DataFrame, now: str | None = None, writer: str | None = None, batch: int | None = None) -> Transaction | None:
    """Jobs (job_id, job_type), queued, each with its first event; ids that are there already are an error."""
    at = moment(now)

    def work(own: Transaction) -> int:
        if not jobs.join(own.current("jobs").select("job_id"), "job_id", "left_semi").isEmpty():
            raise LedgerProblem("job_exists")
        none = F.lit(None).cast("string")
        rows = jobs.select("job_id", "job_type", F.lit("queued").alias("status"), F.lit(0).alias("progress"), at.alias("created_at"), at.alias("updated_at"), none.alias("error_id"), none.alias("error_summary"))
        own.add("job_events", _event(jobs, "created", F.lit(CREATED), F.lit(0), at))
        return own.add("jobs", rows, guards=("jobs",))

    return log.run(work, writer, batch)


def _known(own: Transaction, rows: DataFrame) -> DataFrame:
    """The jobs that rows name; a job that is not there is an error."""
    jobs = own.current("jobs")
    lost = rows.select("job_id").join(jobs.select("job_id"), "job_id", "left_anti").first()
    if lost:
        raise LedgerProblem("job_not_found", lost[0])
    return jobs


def report_progress(log: Log, updates: DataFrame, now: str | None = None, writer: str | None = None, batch: int | None = None) -> Transaction | None:
    """job_id, progress, message: an event for each, and of each job the furthest progress (100 is its success)."""
    at = moment(now)
    progress = F.least(F.greatest(F.col("progress"), F.lit(0)), F.lit(100)).cast("long")

    def work(own: Transaction) -> int:
        rows = updates.select("job_id", progress.alias("progress"), "message")
        jobs = _known(own, rows)
        furthest = rows.groupBy("job_id").agg(F.max("progress").alias("reached"))
        made = jobs.join(furthest, "job_id").withColumn("progress", F.col("reached")).withColumn("status", X.progress_status(F.col("reached"))).withColumn("updated_at", at)
        own.add("job_events", _event(rows, "progress_updated", F.col("message"), F.col("progress"), at))
        return own.add("jobs", made, guards=("jobs",))

    return log.run(work, writer, batch)


def _failed(own: Transaction, rows: DataFrame, kind: str, at: Column) -> int:
    """Rows (the jobs' columns and code, message, stage, retryable, details, summary): errors, events and failed jobs."""
    rows = rows.withColumn("error_id", mark("job_id", "code", at))
    errors = rows.select("error_id", "code", "message", "stage", "retryable", "details", mark(F.lit("correlation"), "error_id").alias("correlation_id"), at.alias("created_at"))
    own.add("errors", errors)
    own.add("job_events", _event(rows, kind, F.col("summary"), F.lit(None), at))
    made = rows.withColumn("status", F.lit("failed")).withColumn("updated_at", at).withColumn("error_summary", F.col("summary"))
    return own.add("jobs", made, guards=("jobs",))


def fail_jobs(log: Log, failures: DataFrame, now: str | None = None, writer: str | None = None, batch: int | None = None) -> Transaction | None:
    """job_id, code, message, stage, retryable, details, summary: one error, one event and the job's state, together."""
    at = moment(now)
    return log.run(lambda own: _failed(own, _known(own, failures).drop("error_id").join(failures, "job_id"), "failed", at), writer, batch)


def recover_jobs(log: Log, summary: str = "job was interrupted", now: str | None = None) -> Transaction:
    """Running jobs of a session that ended: failed, with one error and one event each."""
    at = moment(now)

    def work(own: Transaction) -> int:
        running = own.current("jobs").where("status = 'running'")
        told = {"code": INTERRUPTED, "message": summary, "stage": "job_recovery", "details": None, "summary": summary}
        rows = running.select("*", *[F.lit(v).cast("string").alias(k) for k, v in told.items()], F.lit(True).alias("retryable"))
        return _failed(own, rows, "recovered_as_failed", at)

    return log.run(work)


# --- leases and results


@dataclass
class Lease:
    """Pages that one session may analyse: those whose newest row is of the commit ``fence``."""

    log: Log
    fence: int
    pages: int

    def held(self, own: Transaction | None = None) -> DataFrame:
        rows = own.current("page_records") if own else self.log.current("page_records")
        return rows.where((F.col("status") == "analysis_pending") & (F.col(VERSION) == self.fence))


def lease(log: Log, wanted: DataFrame | None = None, forced: bool = False, now: str | None = None, begun: Transaction | None = None) -> Lease:
    """Take all pages that may be taken, of those ``wanted`` (page_id) if given.

    If another session takes or changes one of them first, the choice is made
    anew, so each page is one session's.  ``begun`` is a transaction that has
    read already.
    """
    at = moment(now)

    def work(own: Transaction) -> int:
        pages = own.current("page_records")
        free = ledger.lease_eligible(pages, own.current("analysis_results"), forced)
        if wanted is not None:
            free = free.join(wanted.select("page_id").distinct(), "page_id", "left_semi")
        taken = pages.join(free, "page_id", "left_semi").withColumn("status", F.lit("analysis_pending")).withColumn("error_summary", F.lit(None)).withColumn("updated_at", at)
        return own.add("page_records", taken, guards=("page_records", "analysis_results"))

    if begun is not None:
        try:
            n = work(begun)
            begun.commit()
            return Lease(log, begun.version or 0, n)
        except Conflict:
            pass
    own = log.run(work)
    return Lease(log, own.version or 0, own.result)  # without pages nothing was committed, and no row is of commit 0


def _first_ids(own: Transaction, pages: DataFrame) -> DataFrame:
    """page_id, kept_id (of the last success, else of the first row) and first_at of pages that have results already."""
    log = own.read("analysis_results").join(pages.select("page_id"), "page_id", "left_semi")
    order = F.struct(VERSION, NUMBER)
    good = F.max_by("analysis_id", F.when(F.col("status") == "succeeded", order))
    return log.groupBy("page_id").agg(F.coalesce(good, F.min_by("analysis_id", order)).alias("kept_id"), F.min("created_at").alias("first_at"))


def succeed(held: Lease, records: DataFrame, now: str | None = None) -> Transaction:
    """Results (page_id, provider, model_name, result_json) of leased pages, with the pages' status, in one commit.

    The transaction's result is the pages that were refused, as their lease was
    lost: page_id, code.
    """
    at = moment(now)

    def work(own: Transaction) -> DataFrame:
        pages = own.once(held.held(own))
        good = records.join(pages.select("page_id"), "page_id", "left_semi")
        made = good.join(_first_ids(own, good), "page_id", "left").select(
            mark("page_id", "result_json", at).alias("analysis_id"), "page_id", F.lit(SCHEMA_VERSION).alias("schema_version"), "provider", "model_name", F.lit("succeeded").alias("status"), "result_json",
            F.lit(None).cast("string").alias("error_id"), F.coalesce("first_at", at).alias("created_at"), at.alias("updated_at"),
        )
        own.add("analysis_results", made, guards=("page_records", "analysis_results"))
        own.add("page_records", pages.join(own.added("analysis_results").select("page_id"), "page_id", "left_semi").withColumn("status", F.lit("analyzed")).withColumn("updated_at", at), guards=("page_records",))
        return records.join(pages.select("page_id"), "page_id", "left_anti").select("page_id", F.lit(LEASE_LOST).alias("code"))

    return held.log.run(work)


def fail(held: Lease, failures: DataFrame, now: str | None = None) -> Transaction:
    """Failures (page_id, code, message, provider, model_name) of leased pages: error, status and result row together.

    Codes of NOT_KEPT leave no row, nor does a failure whose lease was lost.
    A failed analysis keeps the result's id and drops the result before it.
    """
    at = moment(now)

    def work(own: Transaction) -> DataFrame:
        pages = own.once(held.held(own))
        bad = own.once(failures.where(~F.col("code").isin(*NOT_KEPT)).join(pages.select("page_id"), "page_id", "left_semi"))
        rows = bad.withColumn("error_id", mark("page_id", "code", at)).join(_first_ids(own, bad), "page_id", "left")
        none = F.lit(None).cast("string")
        own.add("errors", rows.select("error_id", "code", "message", F.lit("analysis").alias("stage"), F.lit(True).alias("retryable"), none.alias("details"), mark(F.lit("correlation"), "error_id").alias("correlation_id"), at.alias("created_at")))
        results = rows.select(
            F.coalesce("kept_id", mark("page_id", "code", at)).alias("analysis_id"), "page_id", F.lit(SCHEMA_VERSION).alias("schema_version"), F.coalesce("provider", F.lit("unknown")).alias("provider"),
            F.coalesce("model_name", F.lit("unknown")).alias("model_name"), F.lit("failed").alias("status"), none.alias("result_json"), "error_id", F.coalesce("first_at", at).alias("created_at"), at.alias("updated_at"),
        )
        own.add("analysis_results", results, guards=("page_records", "analysis_results"))
        said = X.failure_summary(F.col("message"), mark(F.lit("correlation"), "error_id"), none).alias("said")
        changed = pages.join(rows.select("page_id", said), "page_id").withColumn("status", F.lit("failed")).withColumn("error_summary", F.col("said")).withColumn("updated_at", at)
        own.add("page_records", changed, guards=("page_records",))
        return failures.join(bad.select("page_id"), "page_id", "left_anti").select("page_id", "code")

    return held.log.run(work)


def release(held: Lease, now: str | None = None) -> Transaction:
    """Pages of a lease that were not done go back to what they were before it."""

    def work(own: Transaction) -> int:
        pages = held.held(own)
        before = own.read("page_records").where(F.col(VERSION) < held.fence).join(pages.select("page_id"), "page_id", "left_semi")
        newest = F.max_by(F.struct("status", "error_summary"), F.struct(VERSION, NUMBER)).alias("was")
        # where the rows before the lease were put together since, the page was rendered at least
        was = [F.coalesce("was.status", F.lit("rendered")).alias("status"), F.col("was.error_summary").alias("error_summary")]
        rows = pages.drop("status", "error_summary").join(before.groupBy("page_id").agg(newest), "page_id", "left").select("*", *was).withColumn("updated_at", moment(now))
        return own.add("page_records", rows, guards=("page_records",))

    return held.log.run(work)


def recover_pages(log: Log, summary: str = "analysis was interrupted", now: str | None = None) -> Transaction:
    """Leases of sessions that ended: their pages are failed.  Whoever still holds one has lost it."""

    def work(own: Transaction) -> int:
        pages = own.current("page_records").where("status = 'analysis_pending'")
        return own.add("page_records", pages.withColumn("status", F.lit("failed")).withColumn("error_summary", F.lit(summary)).withColumn("updated_at", moment(now)), guards=("page_records",))

    return log.run(work)


# --- documents


def set_documents(log: Log, rows: DataFrame) -> Transaction:
    """Documents in a new state (all columns)."""
    return log.run(lambda own: own.add("documents", rows, guards=("documents",)))


def add_pages(own: Transaction, pages: DataFrame, assets: DataFrame, images: DataFrame | None = None) -> None:
    """Page records, and of the assets (and images: image_hash, content) those that are not known.

    The known ones must still be there when it is committed.  Images lie in
    Parquet files sorted by their hash, each once; one is found by its hash
    through the row groups' ranges and Bloom filters.
    """
    own.add("page_records", pages)
    known = own.current("image_assets").select("image_hash")
    assets = own.once(assets)
    own.add("image_assets", assets.join(known, "image_hash", "left_anti"), guards=("image_assets",))
    own.touch("image_assets", assets.select("image_hash").distinct())
    if images is not None:
        # the contents move once, and only where some of them are new; where they were dealt out by hash to be joined, they stay there
        new = own.once(images.select("image_hash").distinct().join(known, "image_hash", "left_anti"))
        found = images.join(new, "image_hash", "left_semi")
        own.add("images", found.groupBy("image_hash").agg(F.first("content").alias("content")).sortWithinPartitions("image_hash"))


def drop_documents(own: Transaction, doomed: DataFrame) -> DataFrame:
    """Hide documents, their pages, results and the images that no other page shows; returns the files that may go (file_path)."""
    doomed = own.once(doomed.select("document_id").distinct())
    documents = own.once(own.read("documents", places=True).join(doomed, "document_id", "left_semi"))
    every = own.read("page_records", places=True)
    pages = own.once(every.join(doomed, "document_id", "left_semi").select("page_id", "image_hash", "_file", "_row"))
    results = own.read("analysis_results", places=True).join(pages.select("page_id").distinct(), "page_id", "left_semi")
    shown = pages.select("image_hash").distinct()
    left = every.join(doomed, "document_id", "left_anti").select("image_hash")
    assets = own.once(own.read("image_assets", places=True).join(shown, "image_hash", "left_semi").join(left, "image_hash", "left_anti"))
    if not own.hide("documents", documents):
        raise LedgerProblem("document_not_found")
    images = own.read("images", places=True).join(assets.select("image_hash"), "image_hash", "left_semi")
    for table, rows in (("page_records", pages), ("analysis_results", results), ("image_assets", assets), ("images", images)):
        own.hide(table, rows)
    own.reads("image_assets", shown)  # another import may show one of these images meanwhile
    return documents.select(F.col("original_path").alias("file_path")).unionByName(assets.select("file_path")).distinct()


def delete_documents(log: Log, doomed: DataFrame) -> Transaction:
    """Documents out of all four tables at once.  The files that may go are written down with the commit, for :func:`remove_files`."""

    def work(own: Transaction) -> None:
        name = uuid.uuid4().hex
        drop_documents(own, doomed).write.parquet(f"{log.root}/_gone/{name}")
        own.told["gone"] = [name]

    return log.run(work)


def remove_files(log: Log, workspace: str) -> list[str]:
    """Delete the files that committed deletions left, as far as they lie in the workspace and no row names them again.

    May be repeated: what is gone already is passed over.  Returns what was deleted.
    """
    spark, state = log.spark, log.state()
    if not state.gone:
        return []
    gone = reduce(DataFrame.unionByName, [spark.read.parquet(f"{log.root}/_gone/{n}") for n in state.gone]).distinct()
    named = log.current("documents", state).select(F.col("original_path").alias("file_path")).unionByName(log.current("image_assets", state).select("file_path"))
    fs, root = hadoop(spark, workspace)
    home = fs.makeQualified(root).toUri().normalize().getPath().rstrip("/") + "/"
    done = []
    for row in gone.join(named, "file_path", "left_anti").toLocalIterator():
        path = row[0] if row[0].startswith("/") or ":" in row[0].split("/")[0] else f"{workspace}/{row[0]}"
        _, p = hadoop(spark, path)
        at = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().normalize()
        # it has to lie in the workspace after "." and ".." are resolved, and to be a file itself and not a link out of it
        if at.getPath().startswith(home) and fs.exists(p) and fs.getFileStatus(p).isFile() and not fs.getFileLinkStatus(p).isSymlink():
            fs.delete(p, False)
            done.append(row[0])
    own = log.begin()
    own.told["removed"] = state.gone
    own.commit()
    return done

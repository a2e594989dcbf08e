"""Ledger queries: lookups, joins, rollups, eligibility, cleanup, and state folds.

Plain DataFrame functions over ledger tables; none of them collects rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text as X
from foliograph.schemas import ANALYSIS_JOB_TYPES

DOCUMENT = ("document_id", "original_filename", "file_type", "file_hash", "original_path", "page_count", "status", "error_summary", "job_id", "created_at", "updated_at")
PAGE = ("page_id", "document_id", "page_number", "image_hash", "status", "error_summary", "created_at", "updated_at")
JOB = ("job_id", "job_type", "status", "progress", "created_at", "updated_at")
STATUS_LABELS = {"ready": "已完成", "importing": "导入中", "failed": "已失败", "pending": "等待中"}
STATUS_TONES = {"ready": "success", "failed": "danger", "importing": "warning"}
PAGE_LABELS = {"rendered": "已渲染", "analysis_pending": "分析中", "analyzed": "已分析", "failed": "已失败"}
PAGE_TONES = {"rendered": "success", "analyzed": "success", "analysis_pending": "warning", "failed": "danger"}


def mapped(c, names: dict[str, str], other):
    out = other
    for k, v in names.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def rollup(documents: DataFrame, pages: DataFrame, results: DataFrame) -> DataFrame:
    """Every document with its pages' succeeded and failed results and the time of the latest.

    Counts are made before the documents come in, so documents are shuffled
    once and by their key.
    """
    per = pages.select("document_id", "page_id").join(results.select("page_id", F.col("status").alias("result"), F.col("updated_at").alias("result_at")), "page_id")
    per = per.groupBy("document_id").agg(F.count_if(F.col("result") == "succeeded").alias("succeeded_pages"), F.count_if(F.col("result") == "failed").alias("failed_pages"), F.max("result_at").alias("last_analyzed_at"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return documents.select(*DOCUMENT).join(per, "document_id", "left").select(*DOCUMENT, zero("succeeded_pages"), zero("failed_pages"), "last_analyzed_at")


def failed_pages(pages: DataFrame, results: DataFrame, document_id: str) -> DataFrame:
    own = pages.where(F.col("document_id") == document_id)
    r = results.select("page_id", F.col("status").alias("result_status"))
    return own.join(r, "page_id", "left").where((F.col("status") == "failed") | (F.col("result_status") == "failed")).select(*PAGE).orderBy("page_number")


def needing_analysis(pages: DataFrame, results: DataFrame) -> DataFrame:
    done = results.where("status = 'succeeded'").select("page_id")
    return pages.where(F.col("status").isin("rendered", "failed")).join(done, "page_id", "left_anti").select(*PAGE).orderBy("document_id", "page_number")


def lease_eligible(pages: DataFrame, results: DataFrame, forced: bool = False) -> DataFrame:
    """Pages that a lease can be taken on; forced leases skip the check for an earlier success."""
    if forced:
        return pages.where("status NOT IN ('pending', 'analysis_pending')").select("page_id")
    return needing_analysis(pages, results).select("page_id")


def workbench(pages: DataFrame, assets: DataFrame, results: DataFrame) -> DataFrame:
    """Pages with their image and, once analyzed, the summary of their result."""
    r = page_summary(results.where("status = 'succeeded'")).withColumnRenamed("page_id", "r_page")
    shown = F.col("p.status") == "analyzed"
    out = pages.alias("p").join(assets.select("image_hash", "file_path"), "image_hash", "left").join(r, F.col("p.page_id") == F.col("r_page"), "left")
    return out.select("p.page_id", "p.document_id", "p.page_number", "p.status", F.col("file_path").alias("image_path"), F.col("p.status").isin("rendered", "failed", "analyzed").alias("eligible"), (shown & F.col("r_page").isNotNull()).alias("has_summary"), *[F.when(shown, F.col(c)).alias(c) for c in ("title", "summary")], *[F.coalesce(F.when(shown, F.col(c)), F.lit(0)).alias(c) for c in ("topic_count", "visible_text_char_count")])


def page_summary(results: DataFrame) -> DataFrame:
    """The count of visible text is of bytes."""
    return results.select("page_id", "title", "summary", "keywords", F.size("topics").cast("long").alias("topic_count"), F.coalesce(F.octet_length("visible_text"), F.lit(0)).cast("long").alias("visible_text_char_count"))


def filter_documents(documents: DataFrame, query: str) -> DataFrame:
    label = mapped(F.col("status"), STATUS_LABELS, F.col("status"))
    hay = F.lower(F.concat_ws(" ", "original_filename", "original_path", "file_type", label, "status"))
    return documents.where(hay.contains(X.ws_trim(F.lower(F.lit(query))))).select(*DOCUMENT)


def document_assets(pages: DataFrame, assets: DataFrame, document_id: str) -> DataFrame:
    return pages.where(F.col("document_id") == document_id).select("document_id", "image_hash").distinct().join(assets.select("image_hash", "file_path", "file_size"), "image_hash", "left")


def jobs_with_last_event(jobs: DataFrame, events: DataFrame) -> DataFrame:
    last = events.groupBy("job_id").agg(F.max_by("message", F.struct("created_at", "seq")).alias("last_message"))
    return jobs.select(*JOB).join(last, "job_id", "left").select(*JOB, X.legacy_text(F.col("last_message")).alias("last_message")).orderBy(F.desc("updated_at"), F.desc("created_at"))


def paginate(df: DataFrame, page: int, size: int, *order) -> DataFrame:
    """One page of an ordered table, the last one if there are fewer; never fewer than one page."""
    n = df.count()
    page = min(max(page, 1), max(1, -(-n // size)))
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def latest(log: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The newest row of each key of an append-only log."""
    # max_by combines before it shuffles; no history is sorted
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), seq).alias("row")).select("row.*")


def current_results(log: DataFrame) -> DataFrame:
    """Upserts folded: a success takes its own id, a failure keeps the one before and drops the result; created_at stays the first."""
    per = log.groupBy("page_id").agg(
        F.max_by(F.struct("status", "title", "error_id", "updated_at"), "seq").alias("now"), F.min("created_at").alias("created_at"),
        F.max_by("analysis_id", F.when(F.col("status") == "succeeded", F.col("seq"))).alias("success_id"), F.min_by("analysis_id", "seq").alias("first_id"),
    )
    return per.select("page_id", F.coalesce("success_id", "first_id").alias("analysis_id"), "now.status", "now.title", "now.error_id", "created_at", "now.updated_at")


def job_states(events: DataFrame) -> DataFrame:
    """Jobs folded from events; progress is kept within 0 to 100."""
    per = events.groupBy("job_id").agg(F.max_by(F.struct("event_type", "progress"), F.struct("created_at", "seq")).alias("last"), F.count(F.lit(1)).alias("events"), F.max("created_at").alias("updated_at"))
    progress = F.least(F.greatest(F.col("last.progress"), F.lit(0)), F.lit(100))
    return per.select("job_id", progress.alias("progress"), F.when(F.col("last.event_type") == "error", "failed").otherwise(X.progress_status(progress)).alias("status"), "events", "updated_at")


def batch_outcome(outcomes: DataFrame, key: str) -> DataFrame:
    per = outcomes.groupBy(key).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("succeeded", "failed", "skipped")])
    status = F.when(F.col("failed") == 0, "succeeded").when(F.col("succeeded") == 0, "failed").otherwise("succeeded_with_failures")
    return per.withColumn("final_status", status).withColumn("job_status", F.when(F.col("failed") == 0, "succeeded").otherwise("failed"))


def delete_document(documents: DataFrame, pages: DataFrame, results: DataFrame, assets: DataFrame, doomed: DataFrame) -> dict[str, DataFrame]:
    """What is left of the ledger, and the assets that nothing refers to any more."""
    pages_left = pages.join(doomed, "document_id", "left_anti")
    gone = pages.join(doomed, "document_id", "left_semi")
    return {
        "documents": documents.join(doomed, "document_id", "left_anti"),
        "pages": pages_left,
        "results": results.join(gone.select("page_id"), "page_id", "left_anti"),
        "deleted_results": results.join(gone.select("page_id"), "page_id", "left_semi"),
        "orphans": assets.join(gone.select("image_hash"), "image_hash", "left_semi").join(pages_left.select("image_hash"), "image_hash", "left_anti"),
    }


def recover_pages(pages: DataFrame) -> DataFrame:
    leased = F.col("status") == "analysis_pending"
    return pages.select("page_id", F.when(leased, "failed").otherwise(F.col("status")).alias("status"), F.when(leased, F.lit("analysis was interrupted")).otherwise(F.col("error_summary")).alias("error_summary"), leased.alias("recovered"))


def recover_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'running'").select("job_id", F.lit("failed").alias("status"), "progress", F.concat(F.lit("job_interrupted-"), "job_id").alias("error_id"))


def status_catalog(spark) -> DataFrame:
    from foliograph.schemas import DOCUMENT_STATUSES, JOB_STATUSES, PAGE_STATUSES

    return spark.createDataFrame([(kind, k, s) for kind, all_ in (("document", DOCUMENT_STATUSES), ("page", PAGE_STATUSES), ("job", JOB_STATUSES)) for k, s in enumerate(all_)], "kind string, position int, status string")


def is_analysis_job(c):
    return c.isin(*ANALYSIS_JOB_TYPES)

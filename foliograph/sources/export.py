"""JSON-lines exports of the ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.operators.ledger import DOCUMENT, JOB
from foliograph.sources.commits import read_file, replace_file


def page_lines(pages: DataFrame, assets: DataFrame, results: DataFrame) -> DataFrame:
    """One line a page: its record if the current result succeeded, whatever the page's status, or else a baseline row.

    Records keep their nulls, baseline rows leave them out.
    """
    r = results.where("status = 'succeeded'").select("page_id", "schema_version", "provider", "model_name", "title", "summary", "visible_text", "topics", "keywords", "given_text", F.lit(True).alias("done"))
    p = pages.join(assets.select("image_hash", "file_path"), "image_hash", "left").join(r, "page_id", "left")
    source = F.struct("document_id", "page_number", "original_filename")
    record = F.struct("schema_version", "page_id", "image_hash", F.col("file_path").alias("image_path"), source.alias("source"), F.struct("title", "summary", "visible_text", "topics", "keywords").alias("analysis"), F.struct(F.col("given_text").alias("bm25_text")).alias("retrieval"), F.struct("provider", "model_name").alias("model"))
    base = F.struct("page_id", "document_id", "page_number", "image_hash", F.col("file_path").alias("image_path"), "status", "error_summary")
    line = F.when(F.col("done"), F.to_json(record, {"ignoreNullFields": "false"})).otherwise(F.to_json(base))
    return p.select("page_id", "document_id", "page_number", F.coalesce("done", F.lit(False)).alias("is_record"), line.alias("value"))


def document_lines(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", F.to_json(F.struct(*DOCUMENT)).alias("value"))


def job_lines(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", F.to_json(F.struct(*JOB)).alias("value"))


def write_lines(lines: DataFrame, path: str, *order: str) -> str:
    """Ordered over the whole export by ranges, not in one task.  Returns the folder written.

    Each export is a folder of its own below ``path``; one file says which is
    the current one and is replaced in one step, so readers see the export
    before it or all of the new one.
    """
    name = uuid.uuid4().hex
    (lines.orderBy(*order) if order else lines).select("value").write.text(f"{path}/{name}")
    replace_file(lines.sparkSession, f"{path}/current", name)
    return f"{path}/{name}"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The current export."""
    return spark.read.text(f"{path}/{read_file(spark, f'{path}/current')}")

"""Schemas and closed value sets of the ledger."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_STATUSES = ("pending", "importing", "ready", "failed")
PAGE_STATUSES = ("pending", "rendered", "analysis_pending", "analyzed", "failed")
JOB_STATUSES = ("queued", "running", "succeeded", "failed", "cancelled")
VERSION_STATUSES = ("not_built", "building", "ready", "failed")
ANALYSIS_JOB_TYPES = ("page_analysis", "page_analysis_batch", "document_reanalysis", "document_failed_reanalysis")
SCHEMA_VERSION = "page_analysis_v1"
ANALYZER_VERSION = "cjk_bigram_v1"


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "b": T.BooleanType(), "a": T.ArrayType(T.StringType()), "x": T.BinaryType()}
    fields = []
    for part in spec.split():
        name, kind = part.split(":")
        fields.append(T.StructField(name, kinds[kind[0]], kind.endswith("?")))
    return T.StructType(fields)


TABLES = {
    "settings": _struct("key:s value:s updated_at:s"),
    "errors": _struct("error_id:s code:s message:s stage:s retryable:b details:s? correlation_id:s created_at:s"),
    "jobs": _struct("job_id:s job_type:s status:s progress:l created_at:s updated_at:s error_id:s? error_summary:s?"),
    "job_events": _struct("event_id:s job_id:s event_type:s message:s? progress:l? created_at:s"),
    "documents": _struct("document_id:s original_filename:s file_type:s file_hash:s original_path:s page_count:l? status:s error_summary:s? job_id:s? created_at:s updated_at:s"),
    "image_assets": _struct("image_hash:s file_path:s file_size:l created_at:s"),
    "images": _struct("image_hash:s content:x"),
    "page_records": _struct("page_id:s document_id:s page_number:l image_hash:s status:s error_summary:s? created_at:s updated_at:s"),
    "analysis_results": _struct("analysis_id:s page_id:s schema_version:s provider:s model_name:s status:s result_json:s? error_id:s? created_at:s updated_at:s"),
    "index_versions": _struct("version_id:s provider:s analyzer_version:s status:s index_directory:s document_count:l build_started_at:s? build_finished_at:s? activated_at:s? error_id:s? created_at:s updated_at:s"),
    "index_active": _struct("provider:s version_id:s updated_at:s"),
}
TABLES["schema_migrations"] = _struct("version:l name:s applied_at:s")
KEYS = {"schema_migrations": "version", "settings": "key", "errors": "error_id", "jobs": "job_id", "job_events": "event_id", "documents": "document_id", "image_assets": "image_hash", "images": "image_hash", "page_records": "page_id", "analysis_results": "page_id", "index_versions": "version_id", "index_active": "provider"}

ANALYSIS = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("page_id", T.StringType()),
        T.StructField("image_hash", T.StringType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("source", _struct("document_id:s? page_number:l? original_filename:s?")),
        T.StructField("analysis", _struct("title:s? summary:s? visible_text:s? topics:a? keywords:a?")),
        T.StructField("retrieval", _struct("bm25_text:s?")),
        T.StructField("model", _struct("provider:s? model_name:s?")),
        T.StructField("provider_response", _struct("endpoint_kind:s? raw_json:s?")),
    ]
)


@dataclass(frozen=True)
class Migration:
    """A step from one generation of the tables to the next.

    changes: by table, ("add", column, type, SQL of its value in older rows),
    ("rename", old, new) or ("drop", column, type), in order.
    """

    version: int
    name: str
    changes: dict = field(default_factory=dict)


#: The generations so far; each of them made tables and changed none.
MIGRATIONS = (Migration(1, "initial_ledger"), Migration(2, "jobs_and_events"), Migration(3, "documents_pages_images"), Migration(4, "analysis_results"), Migration(5, "index_versions"))


def columns_at(table: str, version: int, migrations: tuple = MIGRATIONS) -> list[tuple[str, str]]:
    """(name, type) of a table's columns as they were written in a generation: the changes since, undone."""
    names = [(f.name, f.dataType.simpleString()) for f in TABLES[table]]
    for step in sorted((m for m in migrations if m.version > version), key=lambda m: -m.version):
        for kind, *told in reversed(step.changes.get(table, [])):
            if kind == "add":
                names = [n for n in names if n[0] != told[0]]
            elif kind == "rename":
                names = [(told[0], k) if n == told[1] else (n, k) for n, k in names]
            else:
                names = [*names, (told[0], told[1])]
    return names


def lifted(rows: DataFrame, table: str, version: int, migrations: tuple = MIGRATIONS) -> DataFrame:
    """Rows of a generation with the newest columns; other columns stay as they are."""
    for step in sorted((m for m in migrations if m.version > version), key=lambda m: m.version):
        for kind, *told in step.changes.get(table, []):
            if kind == "add":
                rows = rows.withColumn(told[0], F.expr(told[2]).cast(told[1]))
            elif kind == "rename":
                rows = rows.withColumnRenamed(told[0], told[1])
            else:
                rows = rows.drop(told[0])
    return rows

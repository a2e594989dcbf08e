"""Ledger views over the driver's tables, for Spark and, as SQL, for the oracle.

Everything is derived by fixed rules, so that both sides agree.  Times are
text of fixed width, which sorts as time does.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import text as X
from foliograph.sources.scratch import scratch, shared

#: Characters of a page.
PAGE = 1000
START = 1_704_067_200
TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _time(seconds):
    return F.date_format(F.timestamp_seconds(seconds), TIME)


class Views:
    """The ledger of one set of tables; a view is planned when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def raw_documents(self) -> DataFrame:
        """Every document as imported, copies included."""
        n = F.col("doc_id")
        ext = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".PDF", ".docx", ".pptx", ".Pdf")]), (n % 5 + 1).cast("int"))
        name = F.concat(F.lit("doc-"), n.cast("string"), ext)
        status = F.when(n % 7 == 0, "failed").when(n % 7 == 1, "importing").otherwise("ready")
        text = F.coalesce("text", F.lit(""))
        return self.table("documents").select(
            n.alias("seq"), n.cast("string").alias("document_id"), name.alias("original_filename"), X.detect_file_type(name).alias("file_type"),
            F.sha2(text, 256).alias("file_hash"), F.concat(F.lit("originals/"), X.stored_name(F.sha2(text, 256), name)).alias("original_path"),
            F.when(status != "importing", F.ceil(F.length(text) / PAGE)).otherwise(0).alias("page_count"), status.alias("status"),
            F.when(status == "failed", F.concat(F.lit("import failed: "), name)).alias("error_summary"), (n % 150).cast("string").alias("job_id"),
            _time(START + n).alias("created_at"), _time(START + n + n % 97 * 60).alias("updated_at"), text.alias("text"),
        )

    @cached_property
    def documents(self) -> DataFrame:
        """The first document of each content.

        Which rows these are is found out once, from digests, and written down:
        then the shorter list, of the first documents or of the later copies,
        goes to the texts, so that texts move only where neither is small
        enough to be broadcast.
        """
        raw = self.raw_documents
        first = raw.groupBy("file_hash").agg(F.min("seq").alias("seq")).where("seq IS NOT NULL").select("seq")
        if not shared(self.spark):
            return raw.join(first, "seq", "left_semi")
        first = self.listed(first, "first")
        later = self.listed(raw.where("seq IS NOT NULL").select("seq").join(first, "seq", "left_anti"), "later")
        if first.count() < later.count():
            return raw.join(first, "seq", "left_semi")
        return raw.where("seq IS NOT NULL").join(later, "seq", "left_anti")

    def listed(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows of a few numbers each, found out once and written down."""
        path = scratch(self.spark, name)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    @cached_property
    def slices(self) -> DataFrame:
        k = F.posexplode(F.transform(F.sequence(F.lit(1), F.col("pages")), lambda i: F.substring(F.col("text"), (i - 1) * PAGE + 1, F.lit(PAGE)))).alias("k", "slice")
        docs = self.documents.withColumn("pages", F.ceil(F.length("text") / PAGE).cast("int")).where("pages > 0")
        return docs.select("seq", "document_id", "original_filename", "created_at", k).withColumn("page_number", F.col("k").cast("long") + 1)

    @cached_property
    def pages(self) -> DataFrame:
        n = F.col("seq") + F.col("page_number")
        status = F.when(n % 5 == 0, "rendered").when(n % 5 == 1, "analysis_pending").when(n % 5 == 4, "failed").otherwise("analyzed")
        return self.slices.select(
            F.concat_ws("_", "document_id", F.col("page_number").cast("string")).alias("page_id"), "document_id", "page_number", F.sha2("slice", 256).alias("image_hash"),
            status.alias("status"), F.when(status == "failed", F.lit("model timeout")).alias("error_summary"), "created_at", _time(START + F.col("seq") + F.col("page_number") * 30).alias("updated_at"),
            "seq", "slice", "original_filename",
        )

    @cached_property
    def assets(self) -> DataFrame:
        """The first writer of each image; min of a struct combines before the shuffle."""
        first = self.pages.groupBy("image_hash").agg(F.min(F.struct("seq", "page_number", "document_id", F.octet_length("slice").cast("long").alias("size"), "created_at")).alias("f"))
        return first.select("image_hash", F.concat(F.lit("pages/"), F.col("f.document_id"), F.lit("/"), "image_hash", F.lit(".png")).alias("file_path"), F.col("f.size").alias("file_size"), F.col("f.created_at").alias("created_at"))

    @cached_property
    def results(self) -> DataFrame:
        """Current analysis results: labelled documents' pages."""
        labels = self.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        p = self.pages.join(labels, self.pages["seq"] == labels["doc_id"])
        ok = F.col("quality") == 1
        lines = F.split("slice", "\n")
        words = F.filter(F.split("slice", "[ \n]+"), lambda w: w != "")
        yes = lambda c: F.when(ok, c)
        return p.select(
            F.concat(F.lit("a-"), "page_id").alias("analysis_id"), "page_id", F.lit("page_analysis_v1").alias("schema_version"), F.lit("mock").alias("provider"), F.lit("mock-v1").alias("model_name"),
            F.when(ok, "succeeded").otherwise("failed").alias("status"), F.when(~ok, F.concat(F.lit("e-"), "page_id")).alias("error_id"), "created_at", "updated_at",
            yes(F.left(lines[0], F.lit(60))).alias("title"), yes(X.first_line_summary(F.col("slice"))).alias("summary"), yes(F.col("slice")).alias("visible_text"),
            yes(F.slice(words, 1, 3)).alias("topics"), yes(F.slice(words, 4, 2)).alias("keywords"), yes(F.when(F.col("seq") % 3 == 0, F.lit("")).otherwise(F.left("slice", F.lit(200)))).alias("given_text"),
            "document_id", "page_number", "image_hash", "original_filename", "seq",
        )

    @cached_property
    def events(self) -> DataFrame:
        ts = F.col("ts").cast("timestamp")
        return self.table("events").select(
            F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("job_id"), "event_type", F.col("props").alias("message"),
            F.get_json_object("props", "$.k").cast("long").alias("progress"), F.date_format(ts, MICROS).alias("created_at"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        """Folded from the events: the latest decides, and an error stays an error until progress is reported."""
        latest = F.max_by(F.struct("event_type", "progress"), F.struct("created_at", "seq"))
        n = F.col("job_id").cast("long")
        kinds = F.array(*[F.lit(x) for x in ("import", "page_analysis", "page_analysis_batch", "document_reanalysis", "index_rebuild")])
        folded = self.events.groupBy("job_id").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), latest.alias("last"))
        progress = F.least(F.greatest(F.col("last.progress"), F.lit(0)), F.lit(100))
        status = F.when(F.col("last.event_type") == "error", "failed").when(F.col("last.event_type") == "signup", "queued").otherwise(X.progress_status(F.when(progress >= 90, 100).otherwise(progress)))
        return folded.select("job_id", F.element_at(kinds, (n % 5 + 1).cast("int")).alias("job_type"), status.alias("status"), progress.alias("progress"), "created_at", "updated_at")

    @cached_property
    def errors(self) -> DataFrame:
        e = self.events.where("event_type = 'error'")
        code = F.element_at(F.array(*[F.lit(x) for x in ("api_server_bind", "page_not_found", "validation_limit", "analysis_json_invalid", "not_found")]), (F.col("seq") % 5 + 1).cast("int"))
        return e.select(F.concat(F.lit("e-"), "event_id").alias("error_id"), code.alias("code"), F.lit("event failed").alias("message"), "job_id", F.col("message").alias("details"), F.concat(F.lit("c-"), "event_id").alias("correlation_id"), "created_at", "seq")

    @cached_property
    def versions(self) -> DataFrame:
        day = F.substring("created_at", 1, 10)
        n = F.dayofyear(F.to_date("day"))
        status = F.when(n % 4 == 0, "failed").when(n % 4 == 1, "building").otherwise("ready")
        per = self.events.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("document_count"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
        return per.select(F.concat(F.lit("v-"), "day").alias("version_id"), F.lit("bm25").alias("provider"), F.lit("cjk_bigram_v1").alias("analyzer_version"), status.alias("status"), F.concat(F.lit("indexes/bm25/build-"), "day").alias("index_directory"), "document_count", "created_at", "updated_at")

    @cached_property
    def active(self) -> DataFrame:
        """The newest version that is ready and older than the newest three days."""
        newest = F.broadcast(self.versions.agg(F.date_sub(F.to_date(F.substring(F.max("version_id"), 3, 10)), 3).cast("string").alias("day")))  # one row
        ready = self.versions.where("status = 'ready'").crossJoin(newest).where(F.substring("version_id", 3, 10) <= F.col("day"))
        return ready.groupBy("provider").agg(F.max("version_id").alias("version_id"), F.max("updated_at").alias("updated_at"))


#: The same views in SQL.
SQL = rf"""
raw_documents AS (
  SELECT *, 'originals/' || substr(file_hash, 1, 16) || '_' || original_filename AS original_path,
    CASE WHEN status <> 'importing' THEN CAST(ceil(length(text) / {PAGE}.0) AS BIGINT) ELSE 0 END AS page_count,
    CASE WHEN status = 'failed' THEN 'import failed: ' || original_filename END AS error_summary
  FROM (SELECT doc_id AS seq, CAST(doc_id AS VARCHAR) AS document_id, 'doc-' || doc_id || ['.pdf', '.PDF', '.docx', '.pptx', '.Pdf'][doc_id % 5 + 1] AS original_filename,
      ['pdf', 'pdf', 'docx', 'pptx', 'unknown'][doc_id % 5 + 1] AS file_type, sha256(coalesce(text, '')) AS file_hash,
      CASE doc_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'importing' ELSE 'ready' END AS status, CAST(doc_id % 150 AS VARCHAR) AS job_id,
      strftime(make_timestamp(({START} + doc_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created_at,
      strftime(make_timestamp(({START} + doc_id + doc_id % 97 * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS updated_at, coalesce(text, '') AS text FROM documents)
),
ledger_documents AS (SELECT * FROM raw_documents QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY seq) = 1),
slices AS (
  SELECT seq, document_id, original_filename, created_at, page_number, substr(text, CAST((page_number - 1) * {PAGE} + 1 AS BIGINT), {PAGE}) AS slice
  FROM (SELECT *, unnest(range(1, CAST(ceil(length(text) / {PAGE}.0) AS BIGINT) + 1)) AS page_number FROM ledger_documents)
),
page_records AS (
  SELECT document_id || '_' || page_number AS page_id, document_id, page_number, sha256(slice) AS image_hash, status, CASE WHEN status = 'failed' THEN 'model timeout' END AS error_summary, created_at,
    strftime(make_timestamp(({START} + seq + page_number * 30) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS updated_at, seq, slice, original_filename
  FROM (SELECT *, CASE (seq + page_number) % 5 WHEN 0 THEN 'rendered' WHEN 1 THEN 'analysis_pending' WHEN 4 THEN 'failed' ELSE 'analyzed' END AS status FROM slices)
),
image_assets AS (
  SELECT image_hash, 'pages/' || document_id || '/' || image_hash || '.png' AS file_path, CAST(strlen(slice) AS BIGINT) AS file_size, created_at
  FROM page_records QUALIFY row_number() OVER (PARTITION BY image_hash ORDER BY seq, page_number) = 1
),
analysis_results AS (
  SELECT 'a-' || page_id AS analysis_id, page_id, 'page_analysis_v1' AS schema_version, 'mock' AS provider, 'mock-v1' AS model_name, CASE WHEN ok THEN 'succeeded' ELSE 'failed' END AS status,
    CASE WHEN NOT ok THEN 'e-' || page_id END AS error_id, created_at, updated_at, CASE WHEN ok THEN left(string_split(slice, chr(10))[1], 60) END AS title,
    CASE WHEN ok THEN left(coalesce(list_filter(list_transform(string_split(slice, chr(10)), lambda x: trim(x, w)), lambda x: x <> '')[1], ''), 240) END AS summary, CASE WHEN ok THEN slice END AS visible_text,
    CASE WHEN ok THEN words[1:3] END AS topics, CASE WHEN ok THEN words[4:5] END AS keywords, CASE WHEN ok THEN CASE WHEN seq % 3 = 0 THEN '' ELSE left(slice, 200) END END AS given_text,
    document_id, page_number, image_hash, original_filename, seq
  FROM (SELECT p.*, l.quality = 1 AS ok, list_filter(regexp_split_to_array(slice, '[ \n]+'), lambda x: x <> '') AS words,
    chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160) || chr(8195) || chr(8201) || chr(8232) || chr(12288) AS w
    FROM page_records p JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON p.seq = l.doc_id)
),
job_events AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS seq, CAST(user_id AS VARCHAR) AS job_id, event_type, props AS message, CAST(json_extract_string(props, '$.k') AS BIGINT) AS progress,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at FROM events
),
jobs AS (
  SELECT job_id, ['import', 'page_analysis', 'page_analysis_batch', 'document_reanalysis', 'index_rebuild'][CAST(job_id AS BIGINT) % 5 + 1] AS job_type,
    CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'queued' WHEN progress >= 90 THEN 'succeeded' ELSE 'running' END AS status, least(greatest(progress, 0), 100) AS progress, first_at AS created_at, created_at AS updated_at
  FROM (SELECT *, min(created_at) OVER (PARTITION BY job_id) AS first_at FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, seq DESC) = 1)
),
errors AS (
  SELECT 'e-' || event_id AS error_id, ['api_server_bind', 'page_not_found', 'validation_limit', 'analysis_json_invalid', 'not_found'][seq % 5 + 1] AS code, 'event failed' AS message, job_id, message AS details, 'c-' || event_id AS correlation_id, created_at, seq
  FROM job_events WHERE event_type = 'error'
),
index_versions AS (
  SELECT 'v-' || day AS version_id, 'bm25' AS provider, 'cjk_bigram_v1' AS analyzer_version, CASE dayofyear(CAST(day AS DATE)) % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'building' ELSE 'ready' END AS status,
    'indexes/bm25/build-' || day AS index_directory, n AS document_count, a AS created_at, b AS updated_at
  FROM (SELECT substr(created_at, 1, 10) AS day, count(*) AS n, min(created_at) AS a, max(created_at) AS b FROM job_events GROUP BY 1)
),
index_active AS (SELECT provider, max(version_id) AS version_id, max(updated_at) AS updated_at FROM index_versions WHERE status = 'ready' AND substr(version_id, 3) <= (SELECT CAST(CAST(substr(max(version_id), 3) AS DATE) - 3 AS VARCHAR) FROM index_versions) GROUP BY provider)
"""

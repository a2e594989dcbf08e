"""Queries over the ledger and the index, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph.functions import prompts as P
from foliograph.functions import records as R
from foliograph.functions import text as X
from foliograph.operators import ledger as L
from foliograph.operators import grammar, lifecycle, positions, search
from foliograph.plans import changes
from foliograph.plans.base import QUERIES, SQLS, query
from foliograph.plans.views import SQL, Views
from foliograph.sources import export, files

DOC, PAGE, JOB = ", ".join(L.DOCUMENT), ", ".join(L.PAGE), ", ".join(L.JOB)
ROOT_DOC = "1"
QUERY = "the and"
SPACES = "[" + "".join(R.WHITE).replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r").replace("\x0b", "\\x0B").replace("\x0c", "\\f") + "]"


def trimmed(sql: str) -> str:
    return f"regexp_replace({sql}, '^{SPACES}+|{SPACES}+$', '', 'g')"


# --- scans and sources


@query(f"SELECT {PAGE} FROM page_records")
def scan_pages(v):
    return v.pages.select(*L.PAGE)


@query("SELECT page_id, document_id, page_number, image_hash FROM page_records")
def import_pages(v):
    docs = v.documents.select("document_id", "original_filename", F.encode("text", "UTF-8").alias("content"))
    return files.render(docs).where("error IS NULL").select("page_id", "document_id", "page_number", "image_hash")


@query("SELECT document_id, count(*) AS pages FROM slices GROUP BY document_id")
def doc_page_count(v):
    return v.documents.select("document_id", F.ceil(F.length("text") / 1000).alias("pages")).where("pages > 0")


NAMES = """SELECT document_id, original_filename AS name FROM raw_documents UNION ALL SELECT document_id || 'x', ['a.DOCX', 'b.Docx', 'c', 'd.tar.gz', 'e.ppt', 'dir.pdf/f', 'g.DOC'][seq % 7 + 1] FROM raw_documents"""


def _names(v):
    odd = F.element_at(F.array(*[F.lit(x) for x in ("a.DOCX", "b.Docx", "c", "d.tar.gz", "e.ppt", "dir.pdf/f", "g.DOC")]), (F.col("seq") % 7 + 1).cast("int"))
    return v.raw_documents.select("document_id", F.col("original_filename").alias("name")).unionByName(v.raw_documents.select(F.concat("document_id", F.lit("x")).alias("document_id"), odd.alias("name")))


@query(f"SELECT document_id, name, CASE WHEN regexp_extract(name, '\\.([^./]*)$', 1) IN ('pdf','PDF','doc','DOC','docx','DOCX','ppt','PPT','pptx','PPTX') THEN lower(regexp_extract(name, '\\.([^./]*)$', 1)) ELSE 'unknown' END AS file_type FROM ({NAMES})")
def detect_file_type(v):
    return _names(v).select("document_id", "name", X.detect_file_type(F.col("name")).alias("file_type"))


@query(f"SELECT document_id, name FROM ({NAMES}) WHERE lower(regexp_extract(name, '(\\.[^.]*)$', 1)) IN ('.pdf', '.doc', '.docx', '.ppt', '.pptx')")
def supported_files(v):
    return _names(v).where(X.is_supported(F.col("name"))).select("document_id", "name")


@query("SELECT image_hash, CASE regexp_extract(path, '[^.]*$') WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'webp' THEN 'image/webp' ELSE 'image/png' END AS mime, NOT (path LIKE '/%' OR path LIKE '../%') AS safe FROM (SELECT image_hash, CASE length(file_path) % 2 WHEN 0 THEN '../' ELSE '' END || replace(file_path, '.png', ['.png', '.jpg', '.webp', '.jpeg'][file_size % 4 + 1]) AS path FROM image_assets)")
def image_mime(v):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".png", ".jpg", ".webp", ".jpeg")]), (F.col("file_size") % 4 + 1).cast("int"))
    path = F.concat(F.when(F.length("file_path") % 2 == 0, "../").otherwise(""), F.replace(F.col("file_path"), F.lit(".png"), ext))
    return v.assets.select("image_hash", X.image_mime(path).alias("mime"), X.is_safe_relative(path).alias("safe"))


@query("SELECT page_id, '第 ' || page_number || ' 页' AS title, 'mock analysis text' AS bm25_text, image_hash FROM page_records")
def mock_analysis(v):
    made = files.analyse(v.pages.join(v.assets.select("image_hash", F.col("file_path").alias("image_path")), "image_hash"))
    of = lambda p, name: F.get_json_object("record", p).alias(name)
    return made.select("page_id", of("$.analysis.title", "title"), of("$.retrieval.bm25_text", "bm25_text"), of("$.image_hash", "image_hash"))


# --- sinks


@query("SELECT p.page_id, coalesce(r.status = 'succeeded', false) AS is_record, CASE WHEN r.status = 'succeeded' THEN r.title ELSE p.status END AS shown, a.file_path AS image_path FROM page_records p LEFT JOIN image_assets a USING (image_hash) LEFT JOIN analysis_results r USING (page_id)")
def export_pages(v):
    lines = export.page_lines(v.pages, v.assets, v.results)
    of = lambda p: F.get_json_object("value", p)
    return lines.select("page_id", "is_record", F.when(F.col("is_record"), of("$.analysis.title")).otherwise(of("$.status")).alias("shown"), of("$.image_path").alias("image_path"))


@query("SELECT document_id, original_filename, page_count, error_summary FROM ledger_documents")
def export_documents(v):
    back = export.document_lines(v.documents).select(F.from_json("value", "document_id string, original_filename string, page_count long, error_summary string").alias("d"))
    return back.select("d.*")


@query("SELECT image_hash, file_path, file_size, created_at FROM image_assets")
def image_assets(v):
    return v.assets


GRAMS = "SELECT page_id, token, count(*) AS tf FROM (SELECT page_id, a || lead(a) OVER (PARTITION BY page_id ORDER BY i) AS token FROM (SELECT page_id, unnest(string_split(lower(slice), '')) AS a, generate_subscripts(string_split(lower(slice), ''), 1) AS i FROM page_records)) WHERE token IS NOT NULL GROUP BY ALL"


@query(GRAMS)
def bm25_postings(v):
    return search.postings(v.pages.withColumnRenamed("slice", "body"))


@query("SELECT error_id, CASE WHEN code LIKE 'api\\_server\\_%' ESCAPE '\\' THEN 503 WHEN code LIKE 'not\\_found%' ESCAPE '\\' OR code LIKE '%\\_not\\_found%' ESCAPE '\\' THEN 404 WHEN code LIKE 'validation\\_%' ESCAPE '\\' THEN 400 ELSE 500 END AS http_status FROM errors")
def http_status(v):
    return v.errors.select("error_id", X.http_status(F.col("code")).alias("http_status"))


# --- lookups and filters


@query(f"SELECT {PAGE} FROM page_records WHERE page_id = '{ROOT_DOC}_1'")
def page_by_id(v):
    return v.pages.where(F.col("page_id") == f"{ROOT_DOC}_1").select(*L.PAGE)


@query("SELECT * FROM image_assets WHERE image_hash = (SELECT min(image_hash) FROM page_records WHERE document_id = '1')")
def asset_by_hash(v):
    wanted = v.pages.where("document_id = '1'").agg(F.min("image_hash").alias("image_hash"))
    return v.assets.join(F.broadcast(wanted), "image_hash")


@query(f"SELECT {PAGE} FROM page_records WHERE document_id = '2' ORDER BY page_number")
def pages_by_document(v):
    return v.pages.where("document_id = '2'").select(*L.PAGE).orderBy("page_number")


@query(f"SELECT {PAGE} FROM page_records ORDER BY document_id, page_number")
def all_pages(v):
    return v.pages.select(*L.PAGE).orderBy("document_id", "page_number")


@query(f"SELECT {PAGE} FROM page_records WHERE status = 'analysis_pending' ORDER BY document_id, page_number")
def pending_pages(v):
    return v.pages.where("status = 'analysis_pending'").select(*L.PAGE).orderBy("document_id", "page_number")


@query("SELECT page_id, title, topics[1] AS topic FROM analysis_results WHERE status = 'succeeded' ORDER BY page_id")
def succeeded_analyses(v):
    return v.results.where("status = 'succeeded'").select("page_id", "title", F.get("topics", 0).alias("topic")).orderBy("page_id")


@query("SELECT analysis_id, page_id, status, error_id FROM analysis_results WHERE page_id = (SELECT min(page_id) FROM analysis_results)")
def analysis_by_page(v):
    first = v.results.agg(F.min("page_id").alias("page_id"))
    return v.results.join(F.broadcast(first), "page_id").select("analysis_id", "page_id", "status", "error_id")


@query("SELECT r.page_id, r.title, a.file_path AS image_path FROM analysis_results r LEFT JOIN image_assets a USING (image_hash) WHERE r.status = 'succeeded'")
def page_analysis(v):
    return v.results.where("status = 'succeeded'").join(v.assets, "image_hash", "left").select("page_id", "title", F.col("file_path").alias("image_path"))


@query(f"SELECT {JOB} FROM jobs WHERE status = 'running' ORDER BY updated_at")
def running_jobs(v):
    return v.jobs.where("status = 'running'").select(*L.JOB).orderBy("updated_at")


@query("SELECT version_id, updated_at FROM index_versions WHERE status = 'building' ORDER BY updated_at DESC")
def building_versions(v):
    return v.versions.where("status = 'building'").select("version_id", "updated_at").orderBy(F.desc("updated_at"))


@query("SELECT job_id AS key, CASE WHEN job_id = '7' THEN '{}' ELSE arg_max(message, (created_at, seq)) END AS value, coalesce(CASE WHEN job_id = '7' THEN NULL ELSE arg_max(progress, (created_at, seq)) END, 2) AS k FROM job_events GROUP BY job_id")
def settings_kv(v):
    kv = v.events.groupBy("job_id").agg(F.max_by("message", F.struct("created_at", "seq")).alias("m")).select(F.col("job_id").alias("key"), F.when(F.col("job_id") == "7", "{}").otherwise(F.col("m")).alias("value"))
    return kv.withColumn("k", F.coalesce(F.from_json("value", "k long")["k"], F.lit(2)))


@query("SELECT page_id, title, summary, array_to_string(keywords, '|') AS keywords, len(topics) AS topic_count, strlen(visible_text) AS visible_text_char_count FROM analysis_results WHERE status = 'succeeded'")
def page_summary(v):
    return L.page_summary(v.results.where("status = 'succeeded'")).withColumn("keywords", F.array_join("keywords", "|"))


@query("SELECT p.page_id, p.document_id, p.page_number, p.status, a.file_path AS image_path, p.status IN ('rendered', 'failed', 'analyzed') AS eligible, CASE WHEN p.status = 'analyzed' THEN r.title END AS title, CASE WHEN p.status = 'analyzed' THEN r.summary END AS summary, p.status = 'analyzed' AND r.page_id IS NOT NULL AS has_summary, CASE WHEN p.status = 'analyzed' AND r.page_id IS NOT NULL THEN CAST(len(r.topics) AS BIGINT) ELSE 0 END AS topic_count, CASE WHEN p.status = 'analyzed' AND r.page_id IS NOT NULL THEN CAST(coalesce(strlen(r.visible_text), 0) AS BIGINT) ELSE 0 END AS visible_text_char_count FROM page_records p LEFT JOIN image_assets a USING (image_hash) LEFT JOIN (SELECT * FROM analysis_results WHERE status = 'succeeded') r ON p.page_id = r.page_id")
def workbench_pages(v):
    return L.workbench(v.pages, v.assets, v.results)


@query(f"SELECT {DOC} FROM ledger_documents WHERE lower(original_filename || ' ' || original_path || ' ' || file_type || ' ' || CASE status WHEN 'ready' THEN '已完成' WHEN 'importing' THEN '导入中' WHEN 'failed' THEN '已失败' ELSE status END || ' ' || status) LIKE '%docx 导入中%'")
def filter_documents(v):
    return L.filter_documents(v.documents, "  DOCX 导入中 ")


@query(f"SELECT {JOB} FROM jobs WHERE status = 'failed'")
def filter_jobs(v):
    return v.jobs.where("status = 'failed'").select(*L.JOB)


@query(f"SELECT {JOB} FROM jobs WHERE job_type IN ('page_analysis', 'page_analysis_batch', 'document_reanalysis', 'document_failed_reanalysis')")
def analysis_jobs(v):
    return v.jobs.where(L.is_analysis_job(F.col("job_type"))).select(*L.JOB)


@query("SELECT page_id, CASE status WHEN 'rendered' THEN '已渲染' WHEN 'analysis_pending' THEN '分析中' WHEN 'analyzed' THEN '已分析' WHEN 'failed' THEN '已失败' ELSE status END AS label, CASE WHEN status IN ('rendered', 'analyzed') THEN 'success' WHEN status = 'analysis_pending' THEN 'warning' WHEN status = 'failed' THEN 'danger' ELSE 'neutral' END AS tone FROM page_records")
def status_labels(v):
    s = F.col("status")
    return v.pages.select("page_id", L.mapped(s, L.PAGE_LABELS, s).alias("label"), L.mapped(s, L.PAGE_TONES, F.lit("neutral")).alias("tone"))


@query("WITH t(kind, position, status) AS (VALUES ('document',0,'pending'),('document',1,'importing'),('document',2,'ready'),('document',3,'failed'),('page',0,'pending'),('page',1,'rendered'),('page',2,'analysis_pending'),('page',3,'analyzed'),('page',4,'failed'),('job',0,'queued'),('job',1,'running'),('job',2,'succeeded'),('job',3,'failed'),('job',4,'cancelled')), held AS (SELECT 'document' AS kind, status FROM ledger_documents UNION ALL SELECT 'page', status FROM page_records UNION ALL SELECT 'job', status FROM jobs) SELECT kind, CAST(position AS INT) AS position, status, count(h.status) AS rows_ FROM t LEFT JOIN held h USING (kind, status) GROUP BY ALL")
def status_catalog(v):
    """The states that there are, each with the rows that are in it."""
    held = v.documents.select(F.lit("document").alias("kind"), "status").unionByName(v.pages.select(F.lit("page").alias("kind"), "status")).unionByName(v.jobs.select(F.lit("job").alias("kind"), "status"))
    counts = held.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("rows_"))
    return L.status_catalog(v.spark).join(counts, ["kind", "status"], "left").select("kind", "position", "status", F.coalesce("rows_", F.lit(0)).alias("rows_"))


@query("SELECT event_id, concat_ws(',', CASE WHEN NOT (progress * 4 BETWEEN 72 AND 300) THEN 'default_image_dpi' END, CASE WHEN NOT (progress % 10 BETWEEN 1 AND 8) THEN 'conversion_concurrency' END, CASE WHEN NOT (progress % 12 BETWEEN 1 AND 8) THEN 'analysis_concurrency' END, CASE WHEN progress * 20 < 1024 THEN 'api_port' END) AS problems FROM job_events")
def settings_valid(v):
    p = F.col("progress")
    return v.events.select("event_id", F.array_join(X.settings_problems(p * 4, p % 10, p % 12, p * 20, F.lit("127.0.0.1")), ",").alias("problems"))


# --- joins and aggregates

ROLLUP = f"SELECT {', '.join('d.' + c for c in L.DOCUMENT)}, coalesce(sum(CASE WHEN r.status = 'succeeded' THEN 1 ELSE 0 END), 0)::BIGINT AS succeeded_pages, coalesce(sum(CASE WHEN r.status = 'failed' THEN 1 ELSE 0 END), 0)::BIGINT AS failed_pages, max(r.updated_at) AS last_analyzed_at FROM ledger_documents d LEFT JOIN page_records p ON p.document_id = d.document_id LEFT JOIN analysis_results r ON r.page_id = p.page_id"
BY = "GROUP BY " + ", ".join("d." + c for c in L.DOCUMENT)


@query(f"{ROLLUP} {BY}")
def document_rollup(v):
    return L.rollup(v.documents, v.pages, v.results)


@query(f"{ROLLUP} WHERE d.file_hash = (SELECT min(file_hash) FROM ledger_documents) {BY}")
def document_by_hash(v):
    first = v.documents.agg(F.min("file_hash").alias("file_hash"))
    one = v.documents.join(F.broadcast(first), "file_hash", "left_semi")
    return L.rollup(one, v.pages, v.results)


@query(f"{ROLLUP} WHERE d.document_id = '3' {BY}")
def document_by_id(v):
    own = lambda df: df.where("document_id = '3'")
    return L.rollup(own(v.documents), own(v.pages), own(v.results))


@query(f"SELECT {', '.join('p.' + c for c in L.PAGE)} FROM page_records p LEFT JOIN analysis_results r USING (page_id) WHERE p.document_id = '3' AND (p.status = 'failed' OR r.status = 'failed')")
def failed_pages(v):
    return L.failed_pages(v.pages, v.results, "3")


@query("SELECT page_id, file_path AS image_path FROM page_records LEFT JOIN image_assets USING (image_hash)")
def page_image_path(v):
    return v.pages.join(v.assets, "image_hash", "left").select("page_id", F.col("file_path").alias("image_path"))


NEEDING = "FROM page_records p LEFT JOIN analysis_results r ON r.page_id = p.page_id AND r.status = 'succeeded' WHERE p.status IN ('rendered', 'failed') AND r.page_id IS NULL"


@query(f"SELECT {', '.join('p.' + c for c in L.PAGE)} {NEEDING}")
def pages_needing_analysis(v):
    return L.needing_analysis(v.pages, v.results)


@query("SELECT p.page_id FROM page_records p WHERE status IN ('rendered', 'failed') AND NOT EXISTS (SELECT 1 FROM analysis_results r WHERE r.page_id = p.page_id AND r.status = 'succeeded')")
def lease_eligible(v):
    return L.lease_eligible(v.pages, v.results)


DOOMED = "CAST(document_id AS BIGINT) % 10 = 3"


def _deleted(v):
    return L.delete_document(v.documents.select(*L.DOCUMENT), v.pages, v.results, v.assets, v.documents.where(DOOMED).select("document_id"))


@query(f"SELECT analysis_id FROM analysis_results WHERE page_id IN (SELECT page_id FROM page_records WHERE {DOOMED})")
def cascade_analysis(v):
    return _deleted(v)["deleted_results"].select("analysis_id")


@query(f"SELECT document_id FROM ledger_documents WHERE NOT ({DOOMED})")
def delete_document_remaining(v):
    return _deleted(v)["documents"].select("document_id")


@query(f"SELECT image_hash, file_path FROM image_assets WHERE image_hash IN (SELECT image_hash FROM page_records WHERE {DOOMED}) AND image_hash NOT IN (SELECT image_hash FROM page_records WHERE NOT ({DOOMED}))")
def orphan_assets(v):
    return _deleted(v)["orphans"].select("image_hash", "file_path")


@query("SELECT v.version_id, v.document_count, v.index_directory FROM index_active a JOIN index_versions v USING (version_id) WHERE v.status = 'ready'")
def active_version(v):
    return v.active.select("version_id").join(v.versions.where("status = 'ready'"), "version_id").select("version_id", "document_count", "index_directory")


@query("SELECT DISTINCT p.document_id, p.image_hash, a.file_path, a.file_size FROM page_records p LEFT JOIN image_assets a USING (image_hash) WHERE p.document_id = '2'")
def document_assets(v):
    return L.document_assets(v.pages, v.assets, "2")


@query("SELECT d.document_id, j.job_type, j.status AS job_status FROM ledger_documents d LEFT JOIN jobs j USING (job_id)")
def document_jobs(v):
    return v.documents.select("document_id", "job_id").join(v.jobs.select("job_id", "job_type", F.col("status").alias("job_status")), "job_id", "left").drop("job_id")


@query("SELECT image_hash, count(*) AS refs FROM page_records GROUP BY image_hash")
def asset_refcounts(v):
    return v.pages.groupBy("image_hash").agg(F.count(F.lit(1)).alias("refs"))


@query("SELECT status, count(*) AS jobs FROM jobs GROUP BY status")
def job_counts(v):
    return v.jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))


@query("SELECT count(*) AS documents, CAST(sum(coalesce(page_count, 0)) AS BIGINT) AS pages, count(*) FILTER (status = 'failed') AS failed_documents, (SELECT count(*) FROM analysis_results WHERE status = 'failed') AS failed_pages FROM ledger_documents")
def document_totals(v):
    d = v.documents.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce("page_count", F.lit(0))).alias("pages"), F.count_if(F.col("status") == "failed").alias("failed_documents"))
    return d.crossJoin(v.results.agg(F.count_if(F.col("status") == "failed").alias("failed_pages")))  # two single rows


@query("SELECT count(*) FILTER (status = 'analysis_pending' OR status = 'rendered') AS pending, count(*) FILTER (status = 'analyzed') AS analyzed, count(*) FILTER (status = 'failed') AS failed, count(DISTINCT CASE WHEN status IN ('analysis_pending', 'rendered') THEN document_id END) AS documents_pending FROM page_records")
def analysis_stats(v):
    waiting = F.col("status").isin("analysis_pending", "rendered")
    per = v.pages.groupBy("document_id").agg(F.count_if(waiting).alias("w"), F.count_if(F.col("status") == "analyzed").alias("a"), F.count_if(F.col("status") == "failed").alias("f"))
    return per.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("pending"), F.coalesce(F.sum("a"), F.lit(0)).alias("analyzed"), F.coalesce(F.sum("f"), F.lit(0)).alias("failed"), F.count_if(F.col("w") > 0).alias("documents_pending"))


@query("SELECT d.document_id, greatest(coalesce(p.n, 0), coalesce(r.n, 0)) AS failed_pages FROM ledger_documents d LEFT JOIN (SELECT document_id, count(*) AS n FROM page_records WHERE status = 'failed' GROUP BY 1) p USING (document_id) LEFT JOIN (SELECT document_id, count(*) AS n FROM analysis_results WHERE status = 'failed' GROUP BY 1) r USING (document_id)")
def doc_failed_pages(v):
    per = lambda df, n: df.where("status = 'failed'").groupBy("document_id").agg(F.count(F.lit(1)).alias(n))
    both = v.documents.select("document_id").join(per(v.pages, "p"), "document_id", "left").join(per(v.results, "r"), "document_id", "left")
    return both.select("document_id", F.greatest(F.coalesce("p", F.lit(0)), F.coalesce("r", F.lit(0))).alias("failed_pages"))


@query("SELECT coalesce(bool_or(status = 'running' AND job_type IN ('page_analysis', 'page_analysis_batch', 'document_reanalysis', 'document_failed_reanalysis')), false) AS running FROM jobs")
def has_running_analysis(v):
    return v.jobs.agg(F.coalesce(F.bool_or((F.col("status") == "running") & L.is_analysis_job(F.col("job_type"))), F.lit(False)).alias("running"))


@query("SELECT job_id, s AS succeeded, f AS failed, k AS skipped, CASE WHEN f = 0 THEN 'succeeded' WHEN s = 0 THEN 'failed' ELSE 'succeeded_with_failures' END AS final_status, CASE WHEN f = 0 THEN 'succeeded' ELSE 'failed' END AS job_status FROM (SELECT job_id, count(*) FILTER (event_type IN ('purchase', 'click')) AS s, count(*) FILTER (event_type = 'error' AND progress > 60) AS f, count(*) FILTER (NOT (event_type IN ('purchase', 'click')) AND NOT (event_type = 'error' AND progress > 60)) AS k FROM job_events GROUP BY job_id)")
def batch_outcome(v):
    o = F.when(F.col("event_type").isin("purchase", "click"), "succeeded").when((F.col("event_type") == "error") & (F.col("progress") > 60), "failed").otherwise("skipped")
    return L.batch_outcome(v.events.withColumn("outcome", o), "job_id")


@query(f"SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM ({GRAMS}) GROUP BY token")
def bm25_stats(v):
    return search.postings(v.pages.withColumnRenamed("slice", "body")).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


# --- latest rows, order, limits


@query(f"SELECT {JOB}, (SELECT message FROM job_events e WHERE e.job_id = j.job_id ORDER BY created_at DESC, seq DESC LIMIT 1) AS last_message FROM jobs j")
def jobs_with_last_event(v):
    return L.jobs_with_last_event(v.jobs, v.events)


RESULT_LOG = "SELECT job_id AS page_id, 'a-' || event_id AS analysis_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN event_type <> 'error' THEN message END AS title, CASE WHEN event_type = 'error' THEN 'e-' || event_id END AS error_id, created_at, created_at AS updated_at, seq FROM job_events"


@query(f"WITH log AS ({RESULT_LOG}) SELECT l.page_id, coalesce((SELECT analysis_id FROM log s WHERE s.page_id = l.page_id AND s.status = 'succeeded' ORDER BY seq DESC LIMIT 1), (SELECT analysis_id FROM log s WHERE s.page_id = l.page_id ORDER BY seq LIMIT 1)) AS analysis_id, status, title, error_id, (SELECT min(created_at) FROM log s WHERE s.page_id = l.page_id) AS created_at, updated_at FROM log l QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY seq DESC) = 1")
def current_results(v):
    bad = F.col("event_type") == "error"
    log = v.events.select(F.col("job_id").alias("page_id"), F.concat(F.lit("a-"), "event_id").alias("analysis_id"), F.when(bad, "failed").otherwise("succeeded").alias("status"), F.when(~bad, F.col("message")).alias("title"), F.when(bad, F.concat(F.lit("e-"), "event_id")).alias("error_id"), "created_at", F.col("created_at").alias("updated_at"), "seq")
    return L.current_results(log)


@query("SELECT version_id, updated_at FROM index_versions WHERE status = 'failed' ORDER BY updated_at DESC LIMIT 1")
def latest_failed_version(v):
    return v.versions.where("status = 'failed'").select("version_id", "updated_at").orderBy(F.desc("updated_at")).limit(1)


@query(f"SELECT {DOC} FROM ledger_documents ORDER BY created_at DESC, document_id LIMIT 8 OFFSET 16")
def paginate_documents(v):
    return L.paginate(v.documents.select(*L.DOCUMENT), 3, 8, F.desc("created_at"), "document_id")


@query("SELECT document_id, CASE WHEN seq <> (min(seq) OVER (PARTITION BY file_hash)) THEN 'duplicate' ELSE 'success' END AS outcome FROM raw_documents")
def import_outcomes(v):
    first = v.raw_documents.groupBy("file_hash").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    return v.raw_documents.select("seq", "document_id").join(first, "seq", "left").select("document_id", F.when(F.col("first"), "success").otherwise("duplicate").alias("outcome"))


@query("SELECT document_id, file_hash, min(seq) OVER (PARTITION BY file_hash) AS kept_seq FROM raw_documents")
def dedup_documents(v):
    first = v.raw_documents.groupBy("file_hash").agg(F.min("seq").alias("kept_seq"))
    return v.raw_documents.select("document_id", "file_hash").join(first, "file_hash")


# --- scalar functions


@query("SELECT document_id, file_hash FROM raw_documents")
def file_hash(v):
    return v.raw_documents.select("document_id", "file_hash")


ODD = "CASE seq % 4 WHEN 0 THEN '  a/b:' || document_id || '?.pdf ' WHEN 1 THEN 'c\\d*' || document_id || '|.pdf' WHEN 2 THEN '　<' || document_id || '>\".pdf' ELSE original_filename END"


def _odd(v):
    d, k = F.col("document_id"), F.col("seq") % 4
    return F.when(k == 0, F.concat(F.lit("  a/b:"), d, F.lit("?.pdf "))).when(k == 1, F.concat(F.lit("c\\d*"), d, F.lit("|.pdf"))).when(k == 2, F.concat(F.lit("　<"), d, F.lit('>".pdf'))).otherwise(F.col("original_filename"))


CLEAN = trimmed(f"regexp_replace({ODD}, '[/\\\\:*?\"<>|]', '_', 'g')")


@query(f"SELECT document_id, {CLEAN} AS name FROM raw_documents")
def sanitize_filename(v):
    return v.raw_documents.select("document_id", X.sanitize_filename(_odd(v)).alias("name"))


@query(f"SELECT document_id, substr(file_hash, 1, 16) || '_' || {CLEAN} AS name FROM raw_documents")
def stored_name(v):
    return v.raw_documents.select("document_id", X.stored_name(F.col("file_hash"), _odd(v)).alias("name"))


@query(f"SELECT page_id, {trimmed('slice')} AS trimmed FROM page_records")
def ws_trim(v):
    return v.pages.select("page_id", X.ws_trim(F.col("slice")).alias("trimmed"))


def _blank(c):
    return f"nullif({trimmed(c)}, '')"


BM25 = f"coalesce({_blank('given_text')}, nullif(array_to_string(list_filter(list_transform(list_concat([title, summary, visible_text], coalesce(topics, []), coalesce(keywords, [])), lambda x: {trimmed('x')}), lambda x: x IS NOT NULL AND x <> ''), chr(10)), ''))"
COMBINED = f"concat_ws(chr(10), {_blank('title')}, {_blank('summary')}, {_blank('visible_text')}, CASE WHEN len(topics) > 0 THEN array_to_string(topics, ' ') END, CASE WHEN len(keywords) > 0 THEN array_to_string(keywords, ' ') END, {_blank(BM25)}, {_blank('original_filename')})"


@query(f"SELECT page_id, sha256({COMBINED}) AS body_sha256 FROM analysis_results WHERE status = 'succeeded'")
def combined_text(v):
    return search.index_documents(v.results).select("page_id", F.sha2("body", 256).alias("body_sha256"))


@query(f"SELECT page_id, {COMBINED} AS body FROM analysis_results WHERE status = 'succeeded' AND {trimmed(COMBINED)} <> ''")
def index_documents(v):
    return search.index_documents(v.results).select("page_id", "body")


@query(f"SELECT page_id, {BM25} AS bm25_text FROM analysis_results WHERE status = 'succeeded'")
def bm25_text_fallback(v):
    r = v.results.where("status = 'succeeded'")
    return r.select("page_id", X.bm25_text(*[F.col(c) for c in ("given_text", "title", "summary", "visible_text", "topics", "keywords")]).alias("bm25_text"))


REDACTED_SQL = " OR ".join(f"(contains(l, '{k}') AND regexp_matches(substr(t, instr(l, '{k}') + {len(k)}), '^\\s*[:=]'))" for k in X.SECRET_KEYS)
NOTES = "SELECT event_id, t, lower(t) AS l FROM (SELECT event_id, ['api_key=' || message, 'note ' || message, 'Bearer x' || event_id, 'unexpected token at line ' || event_id, repeat('a', 1000), 'SECRET : ' || event_id, 'token a token=b', 'Authorization: x'][seq % 8 + 1] AS t FROM job_events)"


@query(f"SELECT event_id, CASE WHEN contains(l, 'authorization:') OR contains(l, 'bearer ') OR {REDACTED_SQL} THEN '[redacted]' ELSE left(t, 800) END AS redacted FROM ({NOTES})")
def redact_secrets(v):
    m, e = F.col("message"), F.col("event_id")
    notes = [F.concat(F.lit("api_key="), m), F.concat(F.lit("note "), m), F.concat(F.lit("Bearer x"), e), F.concat(F.lit("unexpected token at line "), e), F.lit("a" * 1000), F.concat(F.lit("SECRET : "), e), F.lit("token a token=b"), F.lit("Authorization: x")]
    return v.events.select("event_id", X.redact_secrets(F.element_at(F.array(*notes), (F.col("seq") % 8 + 1).cast("int"))).alias("redacted"))


@query("SELECT event_id, CASE WHEN seq % 3 = 2 THEN NULL ELSE CAST(progress AS VARCHAR) END AS k, CASE WHEN seq % 3 <> 2 THEN '[redacted]' END AS secret, CASE WHEN seq % 3 = 2 THEN 'provider_response_bytes=' || strlen('not json ' || event_id) END AS plain FROM job_events")
def redact_json(v):
    raw = F.when(F.col("seq") % 3 == 2, F.concat(F.lit("not json "), "event_id")).otherwise(F.to_json(F.struct(F.struct(F.col("progress").alias("k"), F.col("event_id").alias("total_tokens")).alias("usage"))))
    out = v.events.select("event_id", R.redact_json(raw).alias("r"))
    of = lambda p: F.get_json_object("r", p)
    return out.select("event_id", of("$.usage.k").alias("k"), of("$.usage.total_tokens").alias("secret"), F.when(F.col("r").startswith("provider"), F.col("r")).alias("plain"))


@query(f"SELECT page_id, coalesce(left(list_filter(list_transform(string_split(slice, chr(10)), lambda x: {trimmed('x')}), lambda x: x <> '')[1], 240), '') AS summary, CASE WHEN length(slice) > 40 THEN left(slice, 40) || '...' ELSE slice END AS short FROM page_records")
def first_line_summary(v):
    return v.pages.select("page_id", X.first_line_summary(F.col("slice")).alias("summary"), X.ui_truncate(F.col("slice"), 40).alias("short"))


@query("SELECT error_id, message || ' 诊断编号: ' || correlation_id || coalesce(' ' || left(CASE WHEN seq % 2 = 0 THEN repeat(details, 30) END, 200), '') AS summary FROM errors")
def failure_summary(v):
    details = F.when(F.col("seq") % 2 == 0, F.repeat("details", F.lit(30)))
    return v.errors.select("error_id", X.failure_summary(F.col("message"), F.col("correlation_id"), details).alias("summary"))


@query("SELECT event_id, CASE WHEN seq % 2 = 0 THEN '页面分析完成 ' || event_id ELSE '批量分析完成' || message END AS message FROM job_events")
def legacy_text(v):
    old = F.when(F.col("seq") % 2 == 0, F.concat(F.lit(X.LEGACY[0][0] + " "), "event_id")).otherwise(F.concat(F.lit(X.LEGACY[1][0]), "message"))
    return v.events.select("event_id", X.legacy_text(old).alias("message"))


@query("SELECT event_id, greatest(1, least(99, progress * 98 // 120 + 1)) AS batch, least(90, 10 + (progress + 1) * 80 // 100) AS pdf, least(90, 30 + (progress + 1) * 60 // 100) AS office FROM job_events")
def progress_formula(v):
    p = F.col("progress")
    return v.events.select("event_id", X.batch_progress(p, F.lit(120)).alias("batch"), X.import_progress(p, F.lit(100), 10, 80).alias("pdf"), X.import_progress(p, F.lit(100), 30, 60).alias("office"))


@query("SELECT e.job_id, least(greatest(progress, 0), 100) AS progress, CASE WHEN event_type = 'error' THEN 'failed' WHEN progress >= 100 THEN 'succeeded' ELSE 'running' END AS status, n AS events, created_at AS updated_at FROM (SELECT *, count(*) OVER (PARTITION BY job_id) AS n FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, seq DESC) = 1) e")
def job_state_fold(v):
    return L.job_states(v.events)


def _raw_answers(v):
    """Answers as a model might give them: plain, in prose, fenced, cut off."""
    p = v.pages.join(v.assets.select("image_hash", F.col("file_path").alias("image_path")), "image_hash")
    n = F.col("seq") + F.col("page_number")
    record = F.struct(
        F.when(n % 11 == 0, "page_analysis_v2").otherwise("page_analysis_v1").alias("schema_version"), F.when(n % 13 == 0, F.col("image_hash")).otherwise(F.col("page_id")).alias("page_id"), "image_hash", "image_path",
        F.struct("document_id", (F.col("page_number") + F.when(n % 17 == 0, 1).otherwise(0)).alias("page_number")).alias("source"),
        F.struct(F.when(n % 3 > 0, F.left("slice", F.lit(20))).alias("title"), F.when(n % 19 > 0, F.lit("s {}")).alias("summary")).alias("analysis"), F.struct(F.when(n % 5 == 0, F.lit("given")).alias("bm25_text")).alias("retrieval"),
        F.when(n % 23 > 0, F.struct(F.lit("mock").alias("provider"), F.lit("m").alias("model_name"))).alias("model"),
    )
    obj = F.to_json(record)
    kind = F.col("seq") % 4
    raw = F.when(kind == 0, F.concat(F.lit("Here it is: "), obj, F.lit(" Done."))).when(kind == 1, F.concat(F.lit("Sure\n```json\n"), obj, F.lit("\n```\nend"))).when(kind == 2, obj).otherwise(F.left(obj, F.length(obj) - 3))
    return p.withColumn("n", n).withColumn("object", obj).withColumn("raw", raw)


@query("SELECT page_id, seq % 4 <> 3 AS found FROM page_records")
def extract_json(v):
    rows = _raw_answers(v)
    found = R.extract_json(F.col("raw"))
    return rows.select("page_id", F.coalesce(found == F.col("object"), F.lit(False)).alias("found"))


CODES = f"SELECT page_id, seq, CASE WHEN seq % 4 = 3 THEN 'analysis_json_invalid' WHEN n % 11 = 0 THEN 'analysis_schema_version_unsupported' WHEN n % 13 = 0 THEN 'analysis_page_id_mismatch' WHEN n % 17 = 0 THEN 'analysis_page_number_mismatch' WHEN n % 23 = 0 THEN 'analysis_field_missing' WHEN n % 19 = 0 AND n % 5 > 0 AND (n % 3 = 0 OR {trimmed('left(slice, 20)')} = '') THEN 'analysis_retrieval_text_missing' END AS error_code FROM (SELECT *, seq + page_number AS n FROM page_records)"


@query(f"SELECT page_id, error_code FROM ({CODES})")
def validate_analysis(v):
    r = _raw_answers(v).withColumn("v", R.validated("raw", "page_id", "document_id", "page_number", "image_hash", "image_path"))
    return r.select("page_id", "v.error_code")


@query(f"SELECT page_id, CASE WHEN error_code IS NULL THEN 'saved' WHEN error_code NOT IN ('analysis_json_invalid', 'analysis_field_missing', 'analysis_schema_version_unsupported', 'analysis_field_invalid', 'analysis_retrieval_text_missing') THEN 'failed' WHEN seq % 3 = 0 THEN 'saved_after_retry' WHEN error_code = 'analysis_json_invalid' THEN 'saved_as_text' ELSE 'failed_after_retry' END AS outcome FROM ({CODES})")
def repair_policy(v):
    r = _raw_answers(v).withColumn("v", R.validated("raw", "page_id", "document_id", "page_number", "image_hash", "image_path"))
    second = F.when(F.col("seq") % 3 != 0, F.col("v.error_code"))
    return r.select("page_id", R.repair_outcome(F.col("v.error_code"), F.col("v.error_path"), second, F.col("v.error_path")).alias("outcome"))


@query("SELECT page_id, CASE WHEN page_number % 7 = 3 THEN 'analysis_array_too_large' WHEN page_number % 7 = 4 THEN 'analysis_text_too_long' END AS error_code, CASE WHEN page_number % 7 = 3 THEN '$.topics' WHEN page_number % 7 = 4 THEN '$.text' END AS error_path FROM page_records")
def json_bounds(v):
    k = F.col("page_number") % 7
    topics = F.when(k == 3, F.array_repeat(F.lit("t"), 513)).otherwise(F.array(F.lit("t")))
    raw = F.to_json(F.struct(F.when(k == 4, F.repeat(F.lit("x"), 50_001)).otherwise(F.col("slice")).alias("text"), topics.alias("topics")))
    return v.pages.select("page_id", R.bounds_error(raw).alias("e")).select("page_id", "e.error_code", "e.error_path")


@query("SELECT event_id, message AS content FROM job_events WHERE seq % 5 <> 0 UNION ALL SELECT event_id, NULL FROM job_events WHERE seq % 5 = 0")
def vendor_content(v):
    kind = F.when(F.col("seq") % 2 == 0, "anthropic").otherwise("openai")
    body = F.when(F.col("seq") % 5 == 0, F.lit('{"error": 1}')).when(kind == "anthropic", F.to_json(F.struct(F.array(F.struct(F.col("message").alias("text"))).alias("content")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(F.col("message").alias("content")).alias("message"))).alias("choices"))))
    return v.events.select("event_id", X.vendor_content(kind, body).alias("content"))


@query("SELECT event_id, ['https://h.example/v1/chat/completions', 'https://api.openai.com/v1/chat/completions', 'http://localhost:11434/v1/chat/completions', 'http://h.example/x/y', 'ftp://h/v1/chat/completions'][seq % 5 + 1] AS url, [NULL, NULL, NULL, 'model_endpoint_insecure', 'model_endpoint_invalid_scheme'][seq % 5 + 1] AS problem FROM job_events")
def endpoint_policy(v):
    k = (F.col("seq") % 5 + 1).cast("int")
    base = F.element_at(F.array(*[F.lit(x) for x in (" https://h.example/v1/ ", "", "http://localhost:11434", "https://h.example/v1", "ftp://h")]), k)
    custom = F.element_at(F.array(*[F.lit(x) for x in ("", "x", "", " http://h.example/x/y", "")]), k)
    url = X.endpoint(base, custom)
    return v.events.select("event_id", url.alias("url"), X.endpoint_error(url).alias("problem"))


@query("SELECT document_id, ['en-US', 'unspecified', 'zh CN', 'deat'][seq % 4 + 1] AS language FROM raw_documents")
def sanitize_language(v):
    given = F.element_at(F.array(*[F.lit(x) for x in ("  en-US! ", "!!", "zh  CN\u3000", "de<>at")]), (F.col("seq") % 4 + 1).cast("int"))
    return v.raw_documents.select("document_id", X.sanitize_language(given).alias("language"))


@query(f"SELECT page_id, '第 ' || page_number || ' 页分析' AS title, coalesce(left(list_filter(list_transform(string_split({trimmed('slice')}, chr(10)), lambda x: {trimmed('x')}), lambda x: x <> '')[1], 240), '模型未返回结构化 JSON，原始响应已保留。') AS summary, '页面分析' AS topic FROM page_records")
def fallback_record(v):
    """The record that is made of an answer without an object: here the page's own text is the answer."""
    import pandas as pd

    names = ["page_id", "document_id", "page_number", "image_hash", "image_path"]

    def run(batches):
        for b in batches:
            made = [files.text_record(dict(zip(names, row, strict=True)), text) for *row, text in b[[*names, "slice"]].itertuples(index=False)]
            yield pd.DataFrame({"page_id": [m["page_id"] for m in made], "title": [m["analysis"]["title"] for m in made], "summary": [m["analysis"]["summary"] for m in made], "topic": [m["analysis"]["topics"][0] for m in made]})

    return v.pages.select(*names[:4], F.lit(None).cast("string").alias("image_path"), "slice").mapInPandas(run, "page_id string, title string, summary string, topic string")


@query("SELECT document_id, ['\\\\srv\\' || document_id, 'C:\\' || document_id, 'plain/' || document_id][seq % 3 + 1] AS shown, replace(['\\\\srv\\' || document_id, 'C:\\' || document_id, 'plain/' || document_id][seq % 3 + 1], '\\', '/') AS slashed FROM raw_documents")
def path_display(v):
    d = F.col("document_id")
    given = F.element_at(F.array(F.concat(F.lit("\\\\?\\UNC\\srv\\"), d), F.concat(F.lit("\\\\?\\C:\\"), d), F.concat(F.lit("plain/"), d)), (F.col("seq") % 3 + 1).cast("int"))
    return v.raw_documents.select("document_id", X.path_display(given).alias("shown"), X.forward_slashes(X.path_display(given)).alias("slashed"))


def _given(values: tuple, by: str = "seq"):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (F.col(by) % len(values) + 1).cast("int"))


MODELS = (" MiMo-V2 ", "GPT-x", "mimo-Pro", "", "Qwen MIMO-1")


@query(f"SELECT document_id, CASE WHEN lower(m) LIKE 'mimo-%' THEN lower(m) ELSE m END AS model_name FROM (SELECT document_id, trim({list(MODELS)}[seq % 5 + 1]) AS m FROM raw_documents)")
def model_names(v):
    return v.raw_documents.select("document_id", X.model_name(_given(MODELS)).alias("model_name"))


OFFERED, ADDRESSES = ("mimo", " openai ", "xiaomi", "other", "siliconflow", "", "anthropic"), ("", " https://api.xiaomimimo.com/v1", "https://a.example ")


@query(f"""SELECT document_id, concat_ws(',', CASE WHEN p NOT IN ('siliconflow', 'mimo', 'openai', 'anthropic') THEN 'model_provider' END, CASE WHEN m = '' THEN 'model_name' END,
  CASE WHEN p NOT IN ('siliconflow', 'mimo', 'openai', 'anthropic') AND b = '' THEN 'endpoint' END, CASE WHEN seq % 4 <> 0 THEN 'api_key' END) AS missing
  FROM (SELECT *, CASE WHEN o IN ('mimo', 'xiaomi') OR (o = 'openai' AND (contains(b, 'xiaomimimo.com') OR lower(m) LIKE 'mimo-%')) THEN 'mimo' ELSE o END AS p
  FROM (SELECT document_id, seq, trim({list(OFFERED)}[seq % 7 + 1]) AS o, trim({list(ADDRESSES)}[seq % 3 + 1]) AS b, trim({list(MODELS)}[seq % 5 + 1]) AS m FROM raw_documents))""")
def missing_configuration(v):
    names = X.missing_configuration(_given(OFFERED), _given(ADDRESSES), F.lit(""), _given(MODELS), F.col("seq") % 4 == 0)
    return v.raw_documents.select("document_id", F.array_join(names, ",").alias("missing"))


@query("SELECT event_id, CASE WHEN seq % 5 = 0 THEN 'not a time' ELSE strftime(CAST(created_at AS TIMESTAMP), '%Y/%-m/%-d %H:%M:%S') END AS shown FROM job_events")
def date_labels(v):
    return v.events.select("event_id", X.date_label(F.when(F.col("seq") % 5 == 0, "not a time").otherwise(F.col("created_at"))).alias("shown"))


def _prompt_sql() -> str:
    """The prompt by JSON functions of the other engine: names sorted, two blanks a level."""
    made = """replace(json_pretty(json_object('analysis', json_object('keywords', json('[]'), 'summary', '', 'title', '', 'topics', json('[]'), 'visible_text', ''), 'image_hash', image_hash, 'image_path', file_path,
      'model', json_object('model_name', 'm"1', 'provider', 'openai'), 'page_id', page_id, 'retrieval', json_object('bm25_text', ''), 'schema_version', 'page_analysis_v1', 'source', json_object('document_id', document_id, 'original_filename', NULL, 'page_number', page_number)))::VARCHAR, '    ', '  ')"""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    whole = f"{text(P.CONTRACT + P.LANGUAGE)} || 'de-DE' || {text(P.VERSION + P.TEMPLATE)} || {made} || {text(P.TASK)}"
    return f"SELECT page_id, length(p) AS chars, sha256(p) AS prompt_sha256, sha256(p || {text(P.AGAIN[0])} || 'bad' || {text(P.AGAIN[1])}) AS repair_sha256 FROM (SELECT page_id, {whole} AS p FROM page_records JOIN image_assets USING (image_hash))"


@query(_prompt_sql())
def page_prompts(v):
    made = P.template(F.col("page_id"), F.col("document_id"), F.col("page_number"), F.col("image_hash"), F.col("file_path"), F.lit("openai"), F.lit('m"1'))
    rows = v.pages.join(v.assets.select("image_hash", "file_path"), "image_hash").select("page_id", P.analysis(F.lit(" de-DE! "), made).alias("p"))
    return rows.select("page_id", F.length("p").cast("long").alias("chars"), F.sha2("p", 256).alias("prompt_sha256"), F.sha2(P.repair(F.col("p"), F.lit("bad")), 256).alias("repair_sha256"))


# --- search

WORD_AND = """
lens AS (SELECT page_id, length(lower(body)) - 1 AS length FROM idx),
tokens AS (SELECT page_id, unnest(list_transform(range(1, length(lower(body))), lambda i: substr(lower(body), i, 2))) AS token FROM idx),
post AS (SELECT page_id, token, count(*) AS tf FROM tokens WHERE token IN ('th', 'he', 'an', 'nd') GROUP BY ALL),
dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token),
words(word, token) AS (VALUES ('the', 'th'), ('the', 'he'), ('and', 'an'), ('and', 'nd')),
stats AS (SELECT count(*) AS n, avg(length) AS avgdl FROM lens),
per AS (SELECT p.page_id, w.word, min(p.tf) AS tf, sum(ln(1 + (s.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE))) AS idf FROM words w JOIN post p USING (token) JOIN dfs d USING (token), stats s GROUP BY p.page_id, w.word HAVING count(*) = 2),
scores AS (SELECT page_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl))), 6) AS score FROM per JOIN lens USING (page_id), stats GROUP BY page_id)
"""


def _ranked(docs, limit):
    q = search.parse(QUERY)
    return search.top(search.rank_texts(docs, q), limit)


@query(f"WITH idx AS (SELECT page_id, slice AS body FROM page_records), {WORD_AND} SELECT page_id, score FROM scores ORDER BY score DESC, page_id LIMIT 20")
def bm25_topk(v):
    docs = v.pages.withColumnRenamed("slice", "body")
    return _ranked(docs, None)


PHRASE = '"the a"'
BOOLEAN = '("the a" OR und^2.5 OR "de la") AND NOT (ing AND "ion ") document_id:1^0.5 original_filename:doc-1*'


def _times(text: str) -> str:
    """Occurrences, for texts that cannot overlap themselves."""
    return f"(length(t) - length(replace(t, '{text}', ''))) // {len(text)}"


def _leaf(text: str, phrase: bool) -> str:
    """SQL for a leaf: hit and score, from t, length, n, average and the pairs' counts."""
    pairs = [text[k : k + 2] for k in range(len(text) - 1)]
    tf = _times(text) if phrase else f"least({', '.join(map(_times, pairs))})"
    rare = " + ".join(f"ln(1 + (n - df['{g}'] + 0.5::DOUBLE) / (df['{g}'] + 0.5::DOUBLE))" for g in pairs)
    return f"CASE WHEN {tf} > 0 THEN ({rare}) * {tf} * 2.2::DOUBLE / ({tf} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / average)) END"


def _scored_sql(texts: list[str], leaves: dict[str, str], hit: str, score: str) -> str:
    pairs = sorted({t[k : k + 2] for t in texts for k in range(len(t) - 1)})
    counts = ", ".join(f"'{g}': count(*) FILTER (WHERE contains(t, '{g}'))" for g in pairs)
    return f"""WITH idx AS (SELECT page_id, document_id, original_filename, lower(slice) AS t, length(slice) - 1 AS length FROM page_records),
stats AS (SELECT count(*) AS n, avg(length) AS average, count(*) FILTER (WHERE document_id = '1') AS own, MAP {{{counts}}} AS df FROM idx),
leaves AS (SELECT page_id, document_id, original_filename, n, own, {', '.join(f'{sql} AS {name}' for name, sql in leaves.items())} FROM idx, stats)
SELECT page_id, round({score}, 6) AS score FROM leaves WHERE {hit} ORDER BY score DESC, page_id LIMIT 20"""


def _asked(v, text):
    """The first 20 pages for a query: pages and the postings of its tokens are read once each, and dealt out by page."""
    parts = int(v.spark.conf.get("spark.sql.shuffle.partitions"))
    tree = grammar.parse(text)
    tokens, beginnings = positions.needed(tree)
    docs = v.pages.withColumnRenamed("slice", "body")
    post = positions.postings(docs, tokens=tokens, beginnings=beginnings).repartition(parts, "page_id")
    pages = docs.select("page_id", "document_id", "original_filename", F.greatest(F.length(F.lower("body")) - 1, F.lit(0)).cast("long").alias("length")).repartition(parts, "page_id")
    return search.top(positions.rank(post, pages, tree), 20)


@query(_scored_sql(["the a"], {"a": _leaf("the a", True)}, "a IS NOT NULL", "a"))
def phrase_search(v):
    return _asked(v, PHRASE)


@query(
    _scored_sql(
        ["the a", "und", "de la", "ing", "ion "], {"a": _leaf("the a", True), "u": _leaf("und", False), "d": _leaf("de la", True), "i": _leaf("ing", False), "o": _leaf("ion ", True)},
        "(a IS NOT NULL OR u IS NOT NULL OR d IS NOT NULL) AND NOT (i IS NOT NULL AND o IS NOT NULL) OR document_id = '1' OR original_filename LIKE 'doc-1%'",
        """CASE WHEN (a IS NOT NULL OR u IS NOT NULL OR d IS NOT NULL) AND NOT (i IS NOT NULL AND o IS NOT NULL) THEN coalesce(a, 0) + coalesce(u, 0) * 2.5::DOUBLE + coalesce(d, 0) ELSE 0 END
  + CASE WHEN document_id = '1' THEN ln(1 + (n - own + 0.5::DOUBLE) / (own + 0.5::DOUBLE)) * 0.5::DOUBLE ELSE 0 END + CASE WHEN original_filename LIKE 'doc-1%' THEN 1 ELSE 0 END""",
    )
)
def boolean_search(v):
    return _asked(v, BOOLEAN)


@query("SELECT page_id, token, count(*) AS tf, min(i - 1) AS first_place, max(i - 1) AS last_place, CAST(sum(i - 1) AS BIGINT) AS places FROM (SELECT page_id, i, substr(t, i, 2) AS token FROM (SELECT page_id, lower(slice) AS t, unnest(range(1, length(slice))) AS i FROM page_records)) GROUP BY ALL")
def positional_postings(v):
    """Postings with their places, taken apart again as a check of their packing."""
    import numpy as np
    import pyarrow as pa

    def seen(batches):
        for b in batches:
            if not b.num_rows:
                continue
            own, starts = positions.places_of(b.column("positions"))
            last = np.append(starts[1:], len(own)) - 1
            ends = [pa.array(x) for x in (own[starts], own[last], np.add.reduceat(own, starts))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("token"), b.column("tf"), *ends], ["page_id", "token", "tf", "first_place", "last_place", "places"])

    return positions.postings(v.pages.withColumnRenamed("slice", "body")).mapInArrow(seen, "page_id string, token string, tf long, first_place long, last_place long, places long")


@query(f"WITH idx AS (SELECT page_id, {COMBINED} AS body FROM analysis_results WHERE status = 'succeeded'), {WORD_AND} SELECT s.page_id, s.score, row_number() OVER (ORDER BY s.score DESC, s.page_id) AS rank, r.document_id, r.page_number, r.original_filename, r.title, a.file_path AS image_path, a.file_path IS NOT NULL AS image_available FROM (SELECT * FROM scores ORDER BY score DESC, page_id LIMIT 10) s JOIN analysis_results r USING (page_id) LEFT JOIN image_assets a USING (image_hash)")
def search_results(v):
    docs = search.index_documents(v.results)
    hits = _ranked(docs, 10)
    return search.enrich(hits, v.results, v.assets).select("page_id", "score", "rank", "document_id", "page_number", "original_filename", "title", "image_path", "image_available")


@query("SELECT page_id, length(t) - 1 AS grams, sha256(array_to_string(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), '|')) AS grams_sha256 FROM (SELECT page_id, lower(slice) AS t FROM page_records)")
def bigrams(v):
    g = X.bigrams(F.col("slice"))
    return v.pages.select("page_id", F.size(g).cast("long").alias("grams"), F.sha2(F.array_join(g, "|"), 256).alias("grams_sha256"))


STATUS = """
WITH b AS (SELECT count(*) FILTER (status = 'building') AS building, count(*) FILTER (status = 'failed') AS failed, max(CASE WHEN status = 'failed' THEN version_id END) AS last_failed FROM index_versions),
a AS (SELECT max(version_id) AS active_version, coalesce(max(document_count), 0) AS indexed FROM index_active JOIN (SELECT version_id, document_count FROM index_versions WHERE status = 'ready') USING (version_id)),
p AS (SELECT count(*) FILTER (status = 'analyzed') AS analyzed FROM page_records), d AS (SELECT count(*) AS indexable FROM analysis_results WHERE status = 'succeeded')
SELECT CASE WHEN building > 0 THEN 'building' WHEN active_version IS NOT NULL THEN 'ready' WHEN failed > 0 THEN 'failed' ELSE 'not_built' END AS status, active_version, indexed, indexable, analyzed, greatest(indexable - indexed, 0) AS pending, greatest(analyzed - indexed, 0) AS skipped,
  indexable > indexed AS stale, active_version IS NOT NULL AS can_search, building = 0 AND indexable > 0 AS can_rebuild, active_version IS NOT NULL AND indexable > indexed AS search_uses_stale_index, last_failed FROM b, a, p, d
"""


@query(STATUS)
def index_status(v):
    return lifecycle.status(v.versions, v.active, v.pages, search.index_documents(v.results))


changes.put_sql(COMBINED)


@query("SELECT job_id AS document_id, event_type AS status, created_at AS updated_at FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1")
def documents_latest(v):
    return L.latest(v.events, "job_id").select(F.col("job_id").alias("document_id"), F.col("event_type").alias("status"), F.col("created_at").alias("updated_at"))


@query("SELECT page_id, CASE WHEN status = 'analysis_pending' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'analysis_pending' THEN 'analysis was interrupted' ELSE error_summary END AS error_summary, status = 'analysis_pending' AS recovered FROM page_records")
def recover_pages(v):
    return L.recover_pages(v.pages)


@query("SELECT job_id, 'failed' AS status, progress, 'job_interrupted-' || job_id AS error_id FROM jobs WHERE status = 'running'")
def recover_jobs(v):
    return L.recover_jobs(v.jobs)


# --- extensions: consistency of ledger and index


@query("SELECT page_id FROM page_records WHERE document_id NOT IN (SELECT document_id FROM ledger_documents WHERE status <> 'failed')")
def orphan_pages(v):
    return v.pages.select("page_id", "document_id").join(v.documents.where("status <> 'failed'").select("document_id"), "document_id", "left_anti").select("page_id")


@query("SELECT page_id FROM page_records WHERE image_hash NOT IN (SELECT image_hash FROM image_assets WHERE file_size > 500)")
def pages_without_asset(v):
    return v.pages.select("page_id", "image_hash").join(v.assets.where("file_size > 500").select("image_hash"), "image_hash", "left_anti").select("page_id")


@query("SELECT page_id, 'not_indexed' AS drift FROM page_records WHERE status = 'analyzed' AND page_id NOT IN (SELECT page_id FROM analysis_results WHERE status = 'succeeded')")
def index_ledger_drift(v):
    docs = search.index_documents(v.results).select("page_id")
    return v.pages.where("status = 'analyzed'").select("page_id").join(docs, "page_id", "left_anti").withColumn("drift", F.lit("not_indexed"))


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in SQLS.items():
        body = sql.strip()
        out[name] = f"WITH {SQL}, {body[5:]}" if body.startswith("WITH ") else f"WITH {SQL} {body}"
    return out


"""One object for callers: import, analyse, search, look up, rebuild, delete, export."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import text
from foliograph.operators import builds, grammar, ledger, lifecycle, mutations, search
from foliograph.schemas import SCHEMA_VERSION
from foliograph.sources import export, files, settings
from foliograph.sources.commits import VERSION, Log

#: How many model calls may be under way at a time.
LEAST_WORKERS, DEFAULT_WORKERS, MOST_WORKERS = 1, 2, 8


class Workspace:
    """A folder with ``ledger/``, ``metadata/`` and ``indexes/bm25/``.

    Everything that changes the ledger is a commit of :class:`Log`; several
    sessions may work on one folder.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.index_root = f"{self.root}/indexes/bm25"
        self.log = Log(spark, self.root)

    def table(self, name: str) -> DataFrame:
        """The current rows of a table; all rows of events and errors."""
        if name in ("job_events", "errors"):
            return self.log.read(name)
        return self.log.current(name).drop(VERSION)

    def _one(self, **values) -> DataFrame:
        return self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])

    def _staged(self, df: DataFrame, name: str) -> DataFrame:
        """Written once, under a name of its own, for work that must not be done twice (rendering, model calls)."""
        path = f"{self.root}/tmp/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def _job(self, kind: str) -> str:
        job_id = uuid.uuid4().hex
        mutations.create_jobs(self.log, self._one(job_id=job_id, job_type=kind))
        return job_id

    def _progress(self, job_id: str, progress: int, message: str) -> None:
        mutations.report_progress(self.log, self._one(job_id=job_id, progress=progress, message=message))

    def _fail_job(self, job_id: str, code: str, message: str, stage: str) -> None:
        mutations.fail_jobs(self.log, self._one(job_id=job_id, code=code, message=message, stage=stage, retryable=True, details=None, summary=message))

    # --- import

    def import_files(self, path: str, renderer: files.Renderer = files.text_pages) -> int:
        """New files to documents, pages and images; contents already there are left alone, also those that failed.

        Documents are ``importing`` first; pages, images and the documents'
        last state then appear together.  What a session that died left
        importing is imported again.
        """
        known = self.table("documents").where("status <> 'importing'").select("document_id")
        return self._import(files.read_files(self.spark, path).join(known, "document_id", "left_anti"), renderer)

    def _import(self, new: DataFrame, renderer: files.Renderer, replaced: str | None = None) -> int:
        job_id = self._job("import")
        try:
            n = self._imported(new, renderer, job_id, replaced)
        except Exception as e:
            self._fail_job(job_id, getattr(e, "code", "import_failed"), str(e)[:200], "import")
            raise
        self._progress(job_id, 100, f"{n} documents")
        return n

    def _imported(self, new: DataFrame, renderer: files.Renderer, job_id: str, replaced: str | None) -> int:
        now = mutations.moment(None)
        none = F.lit(None).cast("string")
        state = lambda df: df.withColumn("job_id", F.lit(job_id)).withColumn("created_at", now).withColumn("updated_at", now)
        facts = new.drop("content")
        if replaced is None:
            mutations.set_documents(self.log, state(facts.withColumn("page_count", F.lit(None)).withColumn("status", F.lit("importing")).withColumn("error_summary", none)))
        pages = self._staged(files.render(new, renderer), "import")
        per = pages.groupBy("document_id").agg(F.count("page_number").alias("page_count"), F.max("error").alias("error_summary"))
        docs = state(facts.join(per, "document_id").withColumn("status", F.when(F.col("error_summary").isNull(), "ready").otherwise("failed")))
        good = pages.where("error IS NULL")
        rows = good.select("page_id", "document_id", "page_number", "image_hash", F.lit("rendered").alias("status"), none.alias("error_summary"), now.alias("created_at"), now.alias("updated_at"))
        first = good.groupBy("image_hash").agg(F.min(F.struct("document_id", "page_number", F.octet_length("image").cast("long").alias("size"))).alias("f"))
        assets = first.select("image_hash", F.concat(F.lit("pages/"), F.col("f.document_id"), F.lit("/"), "image_hash", F.lit(".png")).alias("file_path"), F.col("f.size").alias("file_size"), now.alias("created_at"))

        def work(own) -> int:
            if replaced is not None:
                mutations.drop_documents(own, self._one(document_id=replaced))
            mutations.add_pages(own, rows, assets, good.select("image_hash", F.col("image").alias("content")))
            return own.add("documents", docs, guards=("documents",))

        return self.log.run(work).result

    def retry_import(self, document_id: str, renderer: files.Renderer = files.text_pages) -> int:
        """Import a failed document again; its old rows go in the commit that brings the new ones."""
        row = self.table("documents").where(F.col("document_id") == document_id).first()
        if row is None:
            raise mutations.LedgerProblem("document_not_found", document_id)
        if row["status"] != "failed":
            raise mutations.LedgerProblem("document_not_failed", document_id)
        folder, _, name = row["original_path"].rpartition("/")
        try:
            new = files.read_files(self.spark, folder, name).where(F.col("document_id") == document_id)
            missing = new.isEmpty()
        except Exception as e:
            raise mutations.LedgerProblem("original_file_missing", row["original_path"]) from e
        if missing:
            raise mutations.LedgerProblem("original_file_missing", row["original_path"])
        return self._import(new, renderer, replaced=document_id)

    def delete_document(self, document_id: str) -> list[str]:
        """A document out of the whole ledger at once; then its files, as far as they lie in the workspace."""
        mutations.delete_documents(self.log, self._one(document_id=document_id))
        return mutations.remove_files(self.log, self.root)

    def image(self, image_hash: str) -> bytes | None:
        """The bytes of an image, by a filter that reaches the files' Bloom filters."""
        row = self.log.read("images").where(F.col("image_hash") == image_hash).select("content").first()
        return row and bytes(row[0])

    # --- analysis

    def analyse(self, model=files.mock_model, provider: str = "mock", model_name: str = "mock-v1", workers: int = DEFAULT_WORKERS) -> DataFrame:
        """Every page without a success; returns how many succeeded, failed and were skipped (outcome, count)."""
        return self._analyse("page_analysis_batch", None, False, model, provider, model_name, workers)

    def reanalyse(self, wanted: DataFrame, model=files.mock_model, provider: str = "mock", model_name: str = "mock-v1", workers: int = DEFAULT_WORKERS, kind: str = "document_reanalysis") -> DataFrame:
        """The pages ``wanted`` (page_id) again, whatever they are; those that another session analyses just now are skipped."""
        return self._analyse(kind, wanted, True, model, provider, model_name, workers)

    def reanalyse_document(self, document_id: str, model=files.mock_model, **options) -> DataFrame:
        """All pages of a document again."""
        return self.reanalyse(self.table("page_records").where(F.col("document_id") == document_id).select("page_id"), model, **options)

    def reanalyse_failed(self, document_id: str, model=files.mock_model, **options) -> DataFrame:
        """The pages of a document that failed, or whose result did."""
        wanted = ledger.failed_pages(self.table("page_records"), self.results(), document_id).select("page_id")
        return self.reanalyse(wanted, model, kind="document_failed_reanalysis", **options)

    def _analyse(self, kind: str, wanted: DataFrame | None, forced: bool, model, provider: str, model_name: str, workers: int) -> DataFrame:
        if wanted is not None:
            wanted = wanted.persist(StorageLevel.MEMORY_AND_DISK)
        asked = None if wanted is None else wanted.count()
        job_id = self._job(kind)
        held = mutations.lease(self.log, wanted, forced)
        try:
            pages = held.held().join(self.table("image_assets").select("image_hash", F.col("file_path").alias("image_path")), "image_hash", "left")
            tasks = max(LEAST_WORKERS, min(workers, MOST_WORKERS, held.pages))
            # the pages are dealt out to as many tasks as there may be calls at a time; what they answer is written by the task that commits
            made = self._staged(files.analyse(pages.repartition(tasks), model), "analysis")
            self._progress(job_id, 50, f"{held.pages} pages")
            named = made.withColumn("provider", F.lit(provider)).withColumn("model_name", F.lit(model_name))
            late = mutations.succeed(held, named.where("outcome = 'succeeded'").withColumnRenamed("record", "result_json")).result
            bad = named.where("outcome = 'failed'").select("page_id", F.col("error_code").alias("code"), F.col("error_code").alias("message"), "provider", "model_name")
            unkept = mutations.fail(held, bad).result
        except Exception as e:
            mutations.release(held)
            self._fail_job(job_id, getattr(e, "code", "analysis_failed"), str(e)[:200], "analysis")
            raise
        skipped = late.select("page_id").unionByName(unkept.select("page_id"))
        counts = {r["outcome"]: r["count"] for r in made.join(skipped, "page_id", "left_anti").groupBy("outcome").count().collect()}
        lost = skipped.count() + (max(0, asked - held.pages) if asked is not None else 0)
        if lost:
            counts["skipped"] = lost
        if counts.get("failed"):
            self._fail_job(job_id, "batch_failed", f"{counts['failed']} pages failed", "analysis")
        else:
            self._progress(job_id, 100, f"{counts.get('succeeded', 0)} pages")
        return self.spark.createDataFrame(sorted(counts.items()), "outcome string, count long")

    def recover(self) -> dict:
        """After sessions died: their leases and jobs are failed, silent builds too."""
        pages = mutations.recover_pages(self.log).result
        return {"pages": pages, "jobs": mutations.recover_jobs(self.log).result}

    def results(self) -> DataFrame:
        """Current results, parsed; the newest row of a page decides."""
        now = self.table("analysis_results")
        parsed = now.withColumn("r", F.from_json("result_json", "image_hash string, source struct<document_id:string,page_number:long,original_filename:string>, analysis struct<title:string,summary:string,visible_text:string,topics:array<string>,keywords:array<string>>, retrieval struct<bm25_text:string>"))
        names = self.table("page_records").select("page_id", "document_id").join(self.table("documents").select("document_id", "original_filename"), "document_id", "left").drop("document_id")
        return parsed.select("page_id", "status", "error_id", "updated_at", "provider", "model_name", F.col("r.source.document_id").alias("document_id"), F.col("r.source.page_number").alias("page_number"), F.col("r.image_hash").alias("image_hash"), "r.analysis.*", F.col("r.retrieval.bm25_text").alias("given_text"), "result_json").join(names, "page_id", "left")

    def documents(self) -> DataFrame:
        return ledger.rollup(self.table("documents"), self.table("page_records"), self.results()).orderBy(F.desc("created_at"))

    def document(self, document_id: str) -> dict | None:
        row = self.documents().where(F.col("document_id") == document_id).first()
        return row and row.asDict()

    def page(self, page_id: str) -> dict | None:
        row = self.table("page_records").where(F.col("page_id") == page_id).join(self.results().select("page_id", "title", "summary", "result_json"), "page_id", "left").first()
        return row and row.asDict()

    def jobs(self) -> DataFrame:
        return ledger.jobs_with_last_event(self.table("jobs"), self.log.read("job_events").withColumnRenamed("_number", "seq"))

    def set(self, key: str, value: str) -> None:
        """A setting, in place of its value before."""
        self.log.run(lambda own: own.add("settings", self._one(key=key, value=value).withColumn("updated_at", mutations.moment(None))))

    def setting(self, key: str, default: str | None = None) -> str | None:
        row = self.table("settings").where(F.col("key") == key).first()
        return default if row is None else row["value"]

    def settings(self) -> dict:
        """All settings: built in, then the ledger's record, then ``settings.json`` beside the ledger."""
        return settings.merged(self.setting(settings.RECORD), settings.load(self.spark, f"{self.root}/settings.json", {}))

    def missing_configuration(self, has_key: bool) -> list[str]:
        """What is still to be set before a model can be asked."""
        own = self.settings()
        given = [F.lit(own[k]) for k in ("model_provider", "base_url", "custom_endpoint", "model_name")]
        return list(self.spark.range(1).select(text.missing_configuration(*given, F.lit(has_key))).first()[0])

    def first_page(self, document_id: str) -> dict | None:
        """The first page of a document that has an image, with its path."""
        pages = self.table("page_records").where(F.col("document_id") == document_id).join(self.table("image_assets").select("image_hash", "file_path"), "image_hash")
        row = pages.orderBy("page_number").first()
        return row and row.asDict()

    def search_documents(self) -> DataFrame:
        docs = search.index_documents(self.results())
        return docs.join(self.table("image_assets").select("image_hash", F.col("file_path").alias("image_path")), "image_hash", "left")

    def rebuild_index(self, version_id: str, stale_before: str | None = None) -> dict:
        """A new index version: built, opened, asked, and made active in one commit; until then, and if it fails, the old one is in use.

        Builds whose last heartbeat is older than ``stale_before`` are failed first.
        """
        job_id = self._job("index_rebuild")
        build = None
        try:
            if stale_before:
                builds.fail_stale(self.log, stale_before)
            docs = self.search_documents()
            if docs.isEmpty():
                raise lifecycle.IndexProblem("index_no_documents")
            directory = f"{self.index_root}/build-{version_id}"
            build = builds.start(self.log, version_id, directory)
            self._progress(job_id, 5, "build started")
            pointer = lifecycle.prepare(docs, directory, version_id)
            build.beat()
            self._progress(job_id, 80, "index checked")
            build.ready(pointer["documents"])
        except Exception as e:
            if build is not None and getattr(e, "code", "") != builds.LOST:
                build.failed(getattr(e, "code", "index_build_failed"), str(e)[:200])
            self._fail_job(job_id, getattr(e, "code", "index_build_failed"), str(e)[:200], "index")
            raise
        lifecycle.write_pointer(self.spark, self.index_root, pointer)  # for readers without the ledger
        self._progress(job_id, 100, "index active")
        return pointer

    def index_status(self) -> dict:
        """The state of the index in full: see :func:`foliograph.operators.lifecycle.status`."""
        active = self.table("index_active").select("provider", "version_id")
        row = lifecycle.status(self.table("index_versions"), active, self.table("page_records"), search.index_documents(self.results())).first()
        return row.asDict()

    def search(self, q: str, limit: int | None = None, strict: bool = True) -> dict:
        """{items, query, limit}; a blank query asks nothing."""
        limit = search.clamp(limit)
        if not q.strip():
            return {"items": [], "query": "", "limit": limit}
        version = builds.active(self.log).first()
        if version is None:
            raise lifecycle.IndexProblem("index_not_ready")
        index = lifecycle.open_index(self.spark, version["index_directory"])
        scores = index.rank(grammar.parse(q))
        hits = search.enrich(search.top(scores, limit), self.results(), self.table("image_assets"), strict)
        return {"items": [r.asDict() for r in hits.orderBy("rank").collect()], "query": q.strip(), "limit": limit}

    def export(self) -> None:
        """Pages, documents and jobs as JSON lines, each replaced in one step; :func:`foliograph.sources.export.read_lines` reads them."""
        assets, results = self.table("image_assets"), self.results().withColumn("schema_version", F.lit(SCHEMA_VERSION))
        pages = self.table("page_records").join(self.table("documents").select("document_id", "original_filename"), "document_id", "left")
        export.write_lines(export.page_lines(pages, assets, results.drop("original_filename")), f"{self.root}/metadata/pages.jsonl", "document_id", "page_number")
        export.write_lines(export.document_lines(self.table("documents")), f"{self.root}/metadata/documents.jsonl", "document_id")
        export.write_lines(export.job_lines(self.table("jobs")), f"{self.root}/metadata/jobs.jsonl", "job_id")


def envelope(data=None, error: dict | None = None) -> dict:
    """What a service answers with."""
    return {"data": data} if error is None else {"error": {k: v for k, v in error.items() if v is not None or k != "details"}}

"""Import, analyse, index, search and export of one workspace; the old index survives a failed rebuild."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from foliograph.operators import builds, lifecycle, mutations, search
from foliograph.sources import export
from foliograph.workspace import Workspace


def outcomes(df):
    return {r["outcome"]: r["count"] for r in df.collect()}


def test_round_trip(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    (files / "a.pdf").write_text("采购合同 审查要点 " * 80)
    (files / "b.pdf").write_text("会议纪要")
    (files / "c.PDF").write_text("会议纪要")
    (files / "d.txt").write_text("ignored")
    ws = Workspace(spark, str(tmp_path / "ws"))
    assert ws.import_files(str(files)) == 2
    commits = ws.log.state().version
    assert ws.import_files(str(files)) == 0
    assert [r.status for r in ws.log.read("documents").collect()].count("importing") == 2  # each was, once
    pages = ws.table("page_records").collect()
    assert all(hashlib.sha256(ws.image(p.image_hash)).hexdigest() == p.image_hash for p in pages) and ws.image("none") is None
    assert ws.log.state().version > commits and ws.table("images").count() == ws.table("image_assets").count()
    bad = lambda page: "no object here 采购合同" if page["page_number"] == 1 else "{"
    assert outcomes(ws.analyse(bad, "own", "own-1")) == {"succeeded": 2}
    assert {(r.provider, r.model_name) for r in ws.results().collect()} == {("own", "own-1")}
    assert outcomes(ws.analyse()) == {}
    with pytest.raises(lifecycle.IndexProblem, match="index_not_ready"):
        ws.search("合同")
    assert ws.search("  ") == {"items": [], "query": "", "limit": 20}
    assert ws.index_status()["status"] == "not_built"
    pointer = ws.rebuild_index("1")
    assert ws.index_status()["status"] == "ready"
    hits = ws.search("采购合同", 5)
    assert hits["items"] and hits["limit"] == 5
    with pytest.raises(lifecycle.IndexProblem):
        lifecycle.open_index(spark, ws.index_root + "/build-none")
    with pytest.raises(search.QueryInvalid):
        ws.search("a AND")
    page = hits["items"][0]["page_id"]
    assert [h["page_id"] for h in ws.search(f'"采购合同" AND page_id:{page}')["items"]] == [page]
    assert not ws.search("采购合同 AND NOT object")["items"]
    assert lifecycle.read_pointer(spark, ws.index_root) == pointer
    for _ in range(2):
        ws.export()
    lines = [json.loads(x.value) for x in export.read_lines(spark, str(tmp_path / "ws/metadata/pages.jsonl")).collect()]
    assert len(lines) == len(pages) and all("page_id" in x for x in lines)
    assert [r["succeeded_pages"] for r in ws.documents().collect()] == [1, 1]
    assert {(r.job_type, r.status) for r in ws.jobs().collect()} == {("import", "succeeded"), ("page_analysis_batch", "succeeded"), ("index_rebuild", "succeeded")}


def test_again_retry_and_deletion(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    (files / "a.pdf").write_text("x" * 2500)
    (files / "b.pdf").write_text("bad")
    ws = Workspace(spark, str(tmp_path / "ws"))

    def broken(name, content):
        if name == "b.pdf":
            raise OSError("cannot be read")
        return [content[k : k + 1000] for k in range(0, len(content), 1000)]

    assert ws.import_files(str(files), broken) == 2
    state = {r.original_filename: r for r in ws.table("documents").collect()}
    assert (state["a.pdf"].status, state["b.pdf"].status) == ("ready", "failed")
    a, b = state["a.pdf"].document_id, state["b.pdf"].document_id
    assert ws.first_page(a)["page_number"] == 1 and ws.first_page(b) is None
    some = lambda page: "text" if page["page_number"] < 3 else 1 / 0
    assert outcomes(ws.analyse(some)) == {"failed": 1, "succeeded": 2}
    assert ws.table("errors").where("stage = 'analysis' AND code LIKE 'model_failed%'").count() == 1
    assert ws.table("analysis_results").join(ws.table("errors").select("error_id"), "error_id").count() == 1
    taken = mutations.lease(ws.log, ws.table("page_records").where("page_number = 1"), forced=True)  # another session
    assert outcomes(ws.reanalyse_document(a)) == {"skipped": 1, "succeeded": 2}
    mutations.release(taken)
    assert outcomes(ws.reanalyse_document(a, some)) == {"failed": 1, "succeeded": 2}
    assert outcomes(ws.reanalyse_failed(a)) == {"succeeded": 1}
    with pytest.raises(mutations.LedgerProblem, match="document_not_failed"):
        ws.retry_import(a)
    assert ws.retry_import(b) == 1
    assert {r.document_id: (r.status, r.page_count) for r in ws.table("documents").collect()} == {a: ("ready", 3), b: ("ready", 1)}
    ws.delete_document(a)
    assert [r.document_id for r in ws.table("page_records").collect()] == [b] and ws.results().count() == 0 and ws.table("images").count() == 1
    assert (files / "a.pdf").exists()  # it lies outside the workspace
    ws.set("k", "1")
    ws.set("k", "2")
    assert (ws.setting("k"), ws.setting("none", "d")) == ("2", "d")


def test_settings_in_layers(spark, tmp_path):
    from foliograph.sources import settings

    ws = Workspace(spark, str(tmp_path / "ws"))
    assert ws.settings() == settings.DEFAULTS and ws.missing_configuration(False) == ["model_name", "api_key"]
    ws.set(settings.RECORD, json.dumps({"model_provider": "own", "model_name": "m-1", "api_port": 2000, "unknown": 1}))
    settings.save(spark, f"{ws.root}/settings.json", {"api_port": 3000})
    assert {k: v for k, v in ws.settings().items() if v != settings.DEFAULTS[k]} == {"model_provider": "own", "model_name": "m-1", "api_port": 3000}
    assert ws.missing_configuration(True) == ["model_provider", "endpoint"]
    (tmp_path / "ws" / "settings.json").write_text("{")
    for crc in (tmp_path / "ws").glob(".settings.json*.crc"):
        crc.unlink()
    with pytest.raises(mutations.LedgerProblem, match="settings_parse_failed"):
        ws.settings()
    assert ws.first_page("none") is None


def test_builds(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "ws"))
    with pytest.raises(lifecycle.IndexProblem, match="index_no_documents"):
        ws.rebuild_index("0")
    build = builds.start(ws.log, "v1", "there", "2024-01-01T00:00:00Z")
    with pytest.raises(mutations.LedgerProblem, match="index_version_exists"):
        builds.start(ws.log, "v1", "there")
    build.beat("2024-01-01T00:05:00Z")
    assert builds.fail_stale(ws.log, "2024-01-01T00:04:00Z").result == 0
    other = builds.start(ws.log, "v2", "there", "2024-01-01T00:09:00Z")
    assert builds.fail_stale(ws.log, "2024-01-01T00:06:00Z").result == 1
    assert builds.fail_stale(ws.log, "2024-01-01T00:06:00Z").result == 0
    with pytest.raises(mutations.LedgerProblem, match=builds.LOST):
        build.ready(5)
    other.ready(7, "2024-01-01T00:10:00Z")
    assert builds.active(ws.log).first().version_id == "v2"
    row = builds.version(ws.log, "v1").first()
    assert (row.status, row.error_code) == ("failed", builds.STALE)
    third = builds.start(ws.log, "v3", "there")
    third.failed("disk_full", "no room")
    assert builds.active(ws.log).first().version_id == "v2" and builds.version(ws.log, "v3").first().error_message == "no room"


def test_files_without_pages(spark, tmp_path):
    from foliograph.sources import files

    (tmp_path / "a.pdf").write_text("x")
    got = files.render(files.read_files(spark, str(tmp_path)), lambda name, content: []).collect()
    assert [(r.page_number, r.error) for r in got] == [(None, "pdf_empty_document")]
    assert files.analyse(spark.createDataFrame([("p_1", "p", 1, "h", "i")], "page_id string, document_id string, page_number long, image_hash string, image_path string")).first().outcome == "succeeded"


def test_ranking(spark):
    docs = spark.createDataFrame([("page-a", "采购合同 审查"), ("page-b", "会议纪要"), ("page-c", "合同")], "page_id string, body string")
    rank = lambda q, **o: [r.page_id for r in search.top(search.rank(search.postings(docs), search.lengths(docs), search.parse(q), **o), 5).collect()]
    assert rank("采购合同") == ["page-a"]
    assert rank("采购合同", mode="any_bigram")[0] == "page-a"
    assert set(rank("合同")) == {"page-a", "page-c"}
    assert rank("合同 -采购") == ["page-c"]
    assert rank("+审查 合同") == ["page-a"]
    assert rank("合") == []


def test_streaming_fold(spark, tmp_path):
    from foliograph.plans.views import Views
    from foliograph.streaming import job_fold

    events = Views(spark, "/root/testdata/sf0.001").events
    path = str(tmp_path / "events")
    events.repartition(3).write.parquet(path)
    q = job_fold.start(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path), "folded", str(tmp_path / "cp"))
    q.awaitTermination()
    last = {}
    for r in spark.sql("SELECT * FROM folded").collect():
        if r.job_id not in last or last[r.job_id].events < r.events:
            last[r.job_id] = r
    want = {r.job_id: r for r in job_fold.fold(events).collect()}
    assert last == want


def test_silent_builds_are_failed_by_the_stream(spark, tmp_path):
    from foliograph.sources.commits import Log
    from foliograph.streaming import build_watch

    log = Log(spark, str(tmp_path / "ws"))
    at = lambda minute: f"2024-01-01T00:{minute:02}:00Z"
    kept = {v: builds.start(log, v, "there", at(0)) for v in ("v1", "v2", "v3")}
    schema = "version_id string, status string, at timestamp"
    steps = [[(v, "building", at(0)) for v in kept], [("v2", "building", at(8)), ("v3", "ready", at(9))], [("v2", "building", at(16))], [("v2", "building", at(24))]]
    for rows in steps:  # one file a micro-batch
        df = spark.createDataFrame(rows, "version_id string, status string, t string").select("version_id", "status", F.to_timestamp("t").alias("at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "beats"))
    kept["v3"].ready(1, at(9))
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for _ in range(2):  # the second run finds nothing new
            beats = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "beats"))
            build_watch.fail_silent(log, beats, str(tmp_path / "cp"), now=at(30)).awaitTermination()
    finally:
        spark.conf.set(name, before)
    assert {r.version_id: r.status for r in log.current("index_versions").collect()} == {"v1": "failed", "v2": "building", "v3": "ready"}
    assert log.read("errors").count() == 1 and builds.active(log).first().version_id == "v3"

"""The ledger's commits: two writers, repeated batches, crashes between the steps, deletion and compaction."""

import threading

import pytest
from pyspark.sql import functions as F

from foliograph import schemas
from foliograph.operators import mutations as M
from foliograph.schemas import TABLES
from foliograph.sources import commits
from foliograph.sources.commits import Conflict, Log

NOW = "2024-05-01T00:00:00Z"


def pages(spark, n, status="rendered", document=lambda k: f"d{k % 3}", first=0):
    rows = [(f"p{k}", document(k), k, f"h{k % 4}", status, None, NOW, NOW) for k in range(first, first + n)]
    return spark.createDataFrame(rows, TABLES["page_records"])


def events(spark, ids):
    return spark.createDataFrame([(f"e{k}", f"j{k % 3}", "tick", None, k % 100, NOW) for k in ids], TABLES["job_events"])


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, str(tmp_path / "ws"))


def test_a_number_is_taken_once(spark, tmp_path):
    path, won = str(tmp_path / "x" / "1.json"), []
    tries = [threading.Thread(target=lambda k=k: won.append(k) if commits.put_if_absent(spark, path, str(k)) else None) for k in range(6)]
    for t in tries:
        t.start()
    for t in tries:
        t.join()
    assert len(won) == 1 and commits.read_file(spark, path) == str(won[0])
    assert [p.name for p in (tmp_path / "x").iterdir() if not p.name.endswith(".crc")] == ["1.json"]


def test_batches_are_appended_once_and_numbered_densely(spark, log):
    assert log.read("job_events").count() == 0
    for batch, ids in enumerate([range(10), range(10, 17), range(17, 40)]):
        for _ in range(2):  # the second time nothing is done
            M.append_events(log, events(spark, ids).repartition(3), "w", batch)
    assert M.append_events(log, events(spark, range(100, 105)), "w", 1) is None
    M.append_events(log, events(spark, range(50, 55)), "v", 0)
    got = log.read("job_events").collect()
    assert sorted(r["_number"] for r in got) == list(range(45))
    assert {r["_number"] for r in got if int(r.event_id[1:]) < 10} == set(range(10))
    assert {r["_version"] for r in got} == {1, 2, 3, 4}


def test_what_is_not_committed_is_not_seen(spark, log):
    M.append_events(log, events(spark, range(3)), "w", 0)
    own = log.begin()
    own.add("job_events", events(spark, range(3, 9)))  # and then the writer dies
    assert log.read("job_events").count() == 3
    assert len(log.vacuum()) == 1 and log.read("job_events").count() == 3
    M.append_events(log, events(spark, range(3, 9)), "w", 1)
    assert sorted(r["_number"] for r in log.read("job_events").collect()) == list(range(9))


def test_each_page_is_leased_by_one_session(spark, log):
    log.run(lambda own: own.add("page_records", pages(spark, 12)))
    a, b = log.begin(), log.begin()  # both see every page free
    assert a.state.version == b.state.version
    first = M.lease(log, pages(spark, 6), begun=a)
    second = M.lease(log, begun=b)
    held = lambda x: {r.page_id for r in x.held().collect()}
    assert (first.pages, second.pages) == (6, 6)
    assert held(first) == {f"p{k}" for k in range(6)} and held(second) == {f"p{k}" for k in range(6, 12)}
    none = M.lease(log)
    assert none.pages == 0 and held(none) == set()


def test_keys_of_one_group_are_told_apart(spark, log, monkeypatch):
    monkeypatch.setattr(commits, "BUCKETS", 1)  # all keys are of one group
    log.run(lambda own: own.add("page_records", pages(spark, 12)))
    a, b, c = log.begin(), log.begin(), log.begin()
    first = M.lease(log, pages(spark, 6), begun=a)
    second = M.lease(log, pages(spark, 6, first=6), begun=b)
    assert (a.version, b.version) == (first.fence, second.fence) == (2, 3)  # neither began anew
    third = M.lease(log, pages(spark, 3, first=5), begun=c)
    assert (c.version, third.pages) == (None, 0)


def test_sessions_at_the_same_time(spark, log):
    log.run(lambda own: own.add("page_records", pages(spark, 30)))
    got = {}
    run = lambda k: got.setdefault(k, M.lease(Log(spark, log.root.removesuffix("/ledger")), pages(spark, 18, first=6 * k)))
    tries = [threading.Thread(target=run, args=(k,)) for k in range(3)]
    for t in tries:
        t.start()
    for t in tries:
        t.join()
    held = [{r.page_id for r in x.held().collect()} for x in got.values()]
    assert len(held) == 3 and sum(map(len, held)) == len(set.union(*held)) == 30


def records(spark, ids):
    return spark.createDataFrame([(i, "prov", "model", '{"x": 1}') for i in ids], "page_id string, provider string, model_name string, result_json string")


def test_success_needs_the_lease(spark, log):
    log.run(lambda own: own.add("page_records", pages(spark, 4)))
    old = M.lease(log)
    assert M.succeed(old, records(spark, ["p0"]), NOW).result.count() == 0
    M.recover_pages(log)  # the session is taken for dead
    new = M.lease(log)
    assert new.pages == 3
    late = M.succeed(old, records(spark, ["p1", "p2"]))
    assert {(r.page_id, r.code) for r in late.result.collect()} == {("p1", M.LEASE_LOST), ("p2", M.LEASE_LOST)}
    assert {r.page_id for r in new.held().collect()} == {"p1", "p2", "p3"}
    assert M.succeed(new, records(spark, ["p1"])).result.count() == 0
    assert {r.page_id: r.status for r in log.current("page_records").collect()} == {"p0": "analyzed", "p1": "analyzed", "p2": "analysis_pending", "p3": "analysis_pending"}
    M.release(new)
    assert {r.page_id: r.status for r in log.current("page_records").collect()} == {"p0": "analyzed", "p1": "analyzed", "p2": "failed", "p3": "failed"}


def test_failures_and_their_rule(spark, log):
    log.run(lambda own: own.add("page_records", pages(spark, 5)))
    held = M.lease(log)
    M.succeed(held, records(spark, ["p0"]), NOW)
    again = M.lease(log, records(spark, ["p0"]), forced=True)
    bad = spark.createDataFrame([("p0", "model_failed", "no answer", "prov", "m")], "page_id string, code string, message string, provider string, model_name string")
    first = log.current("analysis_results").first()
    M.fail(again, bad, "2024-06-01T00:00:00Z")
    row = log.current("analysis_results").where("page_id = 'p0'").first()
    assert (row.status, row.result_json, row.analysis_id, row.created_at) == ("failed", None, first.analysis_id, NOW)
    error = log.read("errors").first()
    assert row.error_id == error.error_id and error.code == "model_failed"
    assert log.current("page_records").where("page_id = 'p0'").first().error_summary.startswith("no answer")
    unkept = spark.createDataFrame([(f"p{k + 1}", c, "m", None, None) for k, c in enumerate(M.NOT_KEPT)], bad.schema)
    assert M.fail(held, unkept).result.count() == 3
    assert log.read("errors").count() == 1 and log.current("analysis_results").count() == 1


def test_jobs(spark, log):
    jobs = spark.createDataFrame([("a", "import"), ("b", "import"), ("c", "index_rebuild")], "job_id string, job_type string")
    M.create_jobs(log, jobs, NOW)
    with pytest.raises(M.LedgerProblem, match="job_exists"):
        M.create_jobs(log, jobs.limit(1))
    up = lambda *rows: spark.createDataFrame(list(rows), "job_id string, progress int, message string")
    for _ in range(2):
        M.report_progress(log, up(("a", 10, "x"), ("a", 130, "done"), ("b", -5, None)), NOW, "w", 0)
    with pytest.raises(M.LedgerProblem, match="job_not_found"):
        M.report_progress(log, up(("zz", 1, None)))
    M.fail_jobs(log, spark.createDataFrame([("c", "disk", "full", "index", True, None, "no room")], "job_id string, code string, message string, stage string, retryable boolean, details string, summary string"), NOW)
    assert M.recover_jobs(log, now=NOW).result == 1
    now = {r.job_id: (r.status, r.progress, r.error_summary) for r in log.current("jobs").collect()}
    assert now == {"a": ("succeeded", 100, None), "b": ("failed", 0, "job was interrupted"), "c": ("failed", 0, "no room")}
    kinds = sorted(r.event_type for r in log.read("job_events").collect())
    assert kinds == ["created"] * 3 + ["failed"] + ["progress_updated"] * 3 + ["recovered_as_failed"]
    assert {r.error_id for r in log.current("jobs").where("error_id IS NOT NULL").collect()} == {r.error_id for r in log.read("errors").collect()}


def stocked(spark, log):
    docs = spark.createDataFrame([(f"d{k}", f"d{k}.pdf", "pdf", f"f{k}", f"originals/d{k}.pdf", 4, "ready", None, None, NOW, NOW) for k in range(3)], TABLES["documents"])
    assets = spark.createDataFrame([(f"h{k}", f"pages/h{k}.png", 1, NOW) for k in range(8)], TABLES["image_assets"])

    def work(own):
        own.add("documents", docs)
        # d0 shows h0 and h4 to h7, the others h0 to h3
        own.add("page_records", pages(spark, 12).selectExpr("page_id", "document_id", "page_number", "CASE WHEN document_id = 'd0' AND page_number > 0 THEN concat('h', 4 + page_number % 4) ELSE image_hash END AS image_hash", "status", "error_summary", "created_at", "updated_at"))
        own.add("image_assets", assets)

    log.run(work)
    held = M.lease(log)
    M.succeed(held, records(spark, [f"p{k}" for k in range(6)]))
    M.release(held)


def left(log):
    return {t: log.current(t).count() for t in ("documents", "page_records", "analysis_results", "image_assets")}


def test_deletion_is_seen_whole_or_not_at_all(spark, log, tmp_path, monkeypatch):
    stocked(spark, log)
    before = left(log)
    assert before == {"documents": 3, "page_records": 12, "analysis_results": 6, "image_assets": 8}
    steps = []
    hide = commits.Transaction.hide
    for dies_at in (0, 3):  # after none and after three of the tables

        def dying(self, table, rows, dies_at=dies_at, done=steps):
            if len(done) == dies_at:
                raise OSError("the driver dies")
            done.append(table)
            return hide(self, table, rows)

        steps.clear()
        monkeypatch.setattr(commits.Transaction, "hide", dying)
        with pytest.raises(OSError):
            M.delete_documents(log, spark.createDataFrame([("d0",)], "document_id string"))
        assert left(log) == before
    monkeypatch.setattr(commits.Transaction, "hide", hide)
    root = tmp_path / "ws"
    for name in ("originals/d0.pdf", "pages/h5.png", "pages/h0.png"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    M.delete_documents(log, spark.createDataFrame([("d0",)], "document_id string"))
    assert left(log) == {"documents": 2, "page_records": 8, "analysis_results": 4, "image_assets": 5}
    assert {r.image_hash for r in log.current("image_assets").collect()} == {"h0", "h1", "h2", "h3", "h4"}  # h4 is shown by none
    with pytest.raises(M.LedgerProblem, match="document_not_found"):
        M.delete_documents(log, spark.createDataFrame([("d0",)], "document_id string"))
    assert sorted(M.remove_files(log, str(root))) == ["originals/d0.pdf", "pages/h5.png"]
    assert (root / "pages/h0.png").exists() and M.remove_files(log, str(root)) == []


def test_files_outside_the_workspace_stay(spark, log, tmp_path):
    (tmp_path / "ws").mkdir()
    outside = tmp_path / "keep.pdf"
    outside.write_text("x")
    (tmp_path / "ws" / "link.pdf").symlink_to(outside)
    paths = [str(outside), "../keep.pdf", "a/../../keep.pdf", "link.pdf"]
    log.run(lambda own: own.add("documents", spark.createDataFrame([(f"d{k}", "x", "pdf", f"f{k}", p, 1, "ready", None, None, NOW, NOW) for k, p in enumerate(paths)], TABLES["documents"])))
    M.delete_documents(log, spark.createDataFrame([(f"d{k}",) for k in range(4)], "document_id string"))
    assert M.remove_files(log, str(tmp_path / "ws")) == [] and outside.exists()


def test_deletion_and_import_of_the_same_image(spark, log):
    stocked(spark, log)
    own = log.begin()  # an import that relies on image h5
    M.add_pages(own, spark.createDataFrame([("q1", "d9", 1, "h5", "rendered", None, NOW, NOW)], TABLES["page_records"]), log.current("image_assets").where("image_hash = 'h5'").drop("_version"))
    M.delete_documents(log, spark.createDataFrame([("d0",)], "document_id string"))
    with pytest.raises(Conflict):
        own.commit()


def test_deletion_meets_a_lease(spark, log):
    stocked(spark, log)
    own = log.begin()
    M.drop_documents(own, spark.createDataFrame([("d1",)], "document_id string"))
    M.lease(log)
    with pytest.raises(Conflict):
        own.commit()


def test_compaction_keeps_what_is_read(spark, log):
    stocked(spark, log)
    M.delete_documents(log, spark.createDataFrame([("d2",)], "document_id string"))
    before = sorted(log.current("page_records").collect())
    log.compact("page_records")
    assert sorted(log.current("page_records").collect()) == before
    assert len(log.state().parts["page_records"]) == 1 and log.read("page_records").count() == len(before)
    upto = log.state().version
    held = M.lease(log)
    tail = log.read("page_records", after=upto)
    assert {r["_version"] for r in tail.collect()} == {held.fence}
    for k in range(3):
        M.append_events(log, events(spark, range(10 * k, 10 * k + 10)), "w", k)
    rows = sorted(log.read("job_events").collect())
    log.compact("job_events", newest_only=False)
    assert sorted(log.read("job_events").collect()) == rows
    M.append_events(log, events(spark, range(90, 95)), "w", 3)
    assert sorted(r["_number"] for r in log.read("job_events").collect()) == list(range(35))
    assert log.vacuum() and log.read("job_events").count() == 35


def test_state_is_written_down(spark, log, monkeypatch):
    monkeypatch.setattr(commits, "SNAPSHOT_EVERY", 2)
    for k in range(5):
        M.append_events(log, events(spark, [k]), "w", k)
    fresh = Log(spark, log.root.removesuffix("/ledger"))
    assert fresh.state().__dict__ == log.state().__dict__ and set(fresh._commits) == {5}
    assert fresh.read("job_events", fresh.state(3)).count() == 3


def errors(spark, ids):
    return spark.createDataFrame([(f"e{k:04}", "code", f"message {k}", "s", True, None, f"c{7919 * k % 10_000:04}", NOW) for k in ids], TABLES["errors"])


def test_lookups_skip_parts(spark, log, monkeypatch):
    for k in range(6):
        M.record_errors(log, errors(spark, range(20 * k, 20 * k + 20)), "w", k)
    assert [len(log.candidates("errors", "error_id", f"e{k:04}")) for k in (0, 45, 119)] == [1, 1, 1]
    assert log.candidates("errors", "error_id", "e9999") == [] and log.lookup("errors", "error_id", "e9999").count() == 0
    one = errors(spark, [45]).first()
    # correlation ids are spread over all parts' ranges: the filters tell them apart
    assert len(log.candidates("errors", "correlation_id", one.correlation_id)) <= 2
    found = log.lookup("errors", "correlation_id", one.correlation_id)
    assert [r.error_id for r in found.collect()] == ["e0045"]
    files = found.select(F.input_file_name()).distinct().count()
    parts = lambda df: len({f.split("part=")[1][:32] for f in df.inputFiles()})
    assert files == 1 and parts(found) <= 2 and parts(log.read("errors")) == 6
    monkeypatch.setattr(commits, "BLOOM_ROWS", 3)
    M.record_errors(log, errors(spark, range(500, 520)), "w", 6)
    assert [r.message for r in log.lookup("errors", "error_id", "e0510").collect()] == ["message 510"]


def test_three_generations_read_as_one(spark, tmp_path, monkeypatch):
    root, newest = str(tmp_path / "ws"), TABLES["settings"]
    steps = [
        schemas.Migration(1, "first"),
        schemas.Migration(2, "when", {"settings": [("rename", "at", "updated_at"), ("drop", "owner", "string")]}),
        schemas.Migration(3, "value", {"settings": [("add", "value", "string", "upper(key)")]}),
    ]
    assert [n for n, _ in schemas.columns_at("settings", 1, tuple(steps))] == ["key", "at", "owner"]
    then = [schemas.T.StructType([schemas.T.StructField(n, schemas.T.StringType()) for n, _ in schemas.columns_at("settings", k + 1, tuple(steps))]) for k in range(3)]
    for k in range(3):  # three releases, each with the tables of its day
        log = Log(spark, root, tuple(steps[: k + 1]))
        monkeypatch.setitem(commits.TABLES, "settings", then[k])
        row = {"key": f"k{k}", "value": "own", "updated_at": NOW, "at": NOW, "owner": "o"}
        log.run(lambda own, row=row: own.add("settings", spark.createDataFrame([tuple(row[f.name] for f in commits.TABLES["settings"])], commits.TABLES["settings"])))
    monkeypatch.setitem(commits.TABLES, "settings", newest)
    assert sorted(tuple(r) for r in log.current("settings").select("key", "value", "updated_at").collect()) == [("k0", "K0", NOW), ("k1", "K1", NOW), ("k2", "own", NOW)]
    assert log.migrate(NOW) == [1, 2, 3]
    version = log.state().version
    assert log.migrate() == [] and log.state().version == version
    log.compact("settings")
    assert log.current("settings").where("key = 'k0' AND value = 'K0'").count() == 1
    assert Log(spark, str(tmp_path / "other")).migrate() == [1, 2, 3, 4, 5]

"""How often things are computed and what is moved, where results alone would not tell."""

import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.operators import lifecycle, positions, search
from foliograph.operators import mutations as M
from foliograph.plans.views import Views
from foliograph.schemas import TABLES
from foliograph.sources import files
from foliograph.sources.commits import Log

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def watched(df, path):
    """``df``, and a function that tells how often its one partition was computed."""

    def run(batches):
        with open(path, "a") as f:
            f.write("x")
        yield from batches

    return df.coalesce(1).mapInArrow(run, df.schema), lambda: os.path.getsize(path) if os.path.exists(path) else 0


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def filled(spark, root, n=4):
    """A ledger of n documents of two pages each, every page with an image of its own."""
    log = Log(spark, str(root))
    row = lambda df, **own: {f.name: own.get(f.name, F.lit(None)) for f in TABLES[df]}
    docs = spark.range(n).withColumn("document_id", F.col("id").cast("string"))
    pages = docs.withColumn("page_number", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("page_id", F.concat_ws("_", "document_id", "page_number"))
    own = {
        "documents": docs.select(*[c.alias(k) for k, c in row("documents", document_id=F.col("document_id"), original_path=F.concat(F.lit("o/"), "document_id"), status=F.lit("ready")).items()]),
        "page_records": pages.select(*[c.alias(k) for k, c in row("page_records", page_id=F.col("page_id"), document_id=F.col("document_id"), page_number=F.col("page_number"), image_hash=F.sha2("page_id", 256), status=F.lit("rendered")).items()]),
        "image_assets": pages.select(*[c.alias(k) for k, c in row("image_assets", image_hash=F.sha2("page_id", 256), file_path=F.col("page_id"), file_size=F.lit(1)).items()]),
    }

    def work(t):
        for table, rows in own.items():
            t.add(table, rows)

    log.run(work)
    return log


def test_texts_of_documents_do_not_move(spark):
    """which documents are first is found out from digests; the texts are joined where they are."""
    v = Views(spark, SF)
    assert "Exchange hash" not in plan(v.documents) and "Exchange hash" not in plan(v.pages)
    first = v.raw_documents.groupBy("file_hash").agg(F.min("seq").alias("seq"))
    assert v.documents.select("seq").exceptAll(first.select("seq")).isEmpty() and v.documents.count() == first.count()


def test_many_copies_of_few_documents(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") > 1, (F.col("id") % 3).cast("string")).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.seq for r in Views(spark, str(tmp_path)).documents.collect()) == [0, 2, 3, 4]


def test_pages_are_rendered_in_batches(spark):
    """not one table a document; large documents close a batch, and the pages stay in order."""
    docs = spark.range(50).select(F.col("id").cast("string").alias("document_id"), F.lit("a.pdf").alias("original_filename"), F.encode(F.repeat(F.lit("a"), (F.col("id") * 100).cast("int")), "UTF-8").alias("content"))
    got = files.render(docs)
    assert "MapInArrow" in plan(got)
    rows = got.collect()
    assert len([r for r in rows if r.error]) == 1 and len(rows) == 1 + sum(-(-k * 100 // 1000) for k in range(1, 50))
    assert {(r.document_id, r.page_number): len(r.image) for r in rows if not r.error}["49", 5] == 900
    before, files.RENDERED_BYTES = files.RENDERED_BYTES, 1
    try:
        assert sorted(map(tuple, files.render(docs).collect()), key=str) == sorted(map(tuple, rows), key=str)
    finally:
        files.RENDERED_BYTES = before


def test_index_build_makes_postings_once(spark, tmp_path):
    """once for the postings and once for the lengths; ranges of tokens needed one time more."""
    docs = spark.range(300).select(F.col("id").cast("string").alias("page_id"), F.concat(F.lit("words and "), F.sha2(F.col("id").cast("string"), 256)).alias("body"))
    seen, times = watched(docs, f"{tmp_path}/times")
    assert lifecycle.build(seen, f"{tmp_path}/index") == 300
    assert times() == 2
    index = lifecycle.open_index(spark, f"{tmp_path}/index")
    assert index.postings.where("token = 'wo'").count() == 300


@pytest.mark.parametrize("texts", [["", "a", "abab", "aé采aé采", "😀😀x" * 5], ["ab" * 40, "b" * 70], []])
def test_pairs_sorted_as_one_number(texts):
    """the same pairs at the same places as by brute force."""
    doc, pair, n, data, ends = positions._pairs(texts, None, [])
    got = [(int(d), positions._token(int(p)), positions.places(data[a:b]).tolist()) for d, p, a, b in zip(doc, pair, ends, ends[1:])]
    want = [(d, g, [k for k in range(len(t) - 1) if t[k : k + 2] == g]) for d, t in enumerate(texts) for g in sorted({t[k : k + 2] for k in range(len(t) - 1)})]
    assert got == want and list(n) == [len(x[2]) for x in want]


def test_searched_documents(spark):
    """a page is searched if any of its parts is not blank."""
    rows = [("a", " ", None, None, None, None, None, None), ("b", None, None, None, [" ", ""], None, None, "\n"), ("c", None, None, None, ["x"], None, None, None), ("d", None, None, None, None, None, " t ", None), ("e", None, None, None, None, None, None, "f")]
    df = spark.createDataFrame(rows, "page_id string, title string, summary string, visible_text string, topics array<string>, keywords array<string>, given_text string, original_filename string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("document_id", "image_hash")}).withColumn("page_number", F.lit(1)).withColumn("status", F.lit("succeeded"))
    assert sorted(r.page_id for r in search.index_documents(df).collect()) == ["c", "d", "e"]


def test_deletion_finds_the_doomed_once(spark, tmp_path):
    """who goes is found out once, not once for each table and look."""
    log = filled(spark, tmp_path)
    doomed, times = watched(spark.createDataFrame([("1",)], "document_id string"), f"{tmp_path}/times")
    M.delete_documents(log, doomed)
    assert times() == 1
    assert log.current("page_records").count() == 6 and log.current("image_assets").count() == 6 and log.current("documents").count() == 3
    log.vacuum()
    assert not os.path.exists(f"{log.root}/_once") and log.current("page_records").count() == 6


def test_known_images_do_not_move(spark, tmp_path):
    """a second import of the same images shuffles none of their contents."""
    log = Log(spark, str(tmp_path / uuid.uuid4().hex))
    rng = np.random.default_rng(1)
    spark.createDataFrame([(f"{k:064x}", bytearray(rng.bytes(20_000))) for k in range(100)], "image_hash string, content binary").write.parquet(f"{tmp_path}/images")
    images = spark.read.parquet(f"{tmp_path}/images")
    images = images.unionByName(images)
    assets = images.select("image_hash").distinct().select("image_hash", F.lit("p").alias("file_path"), F.lit(1).cast("long").alias("file_size"), F.lit("t").alias("created_at"))
    none = log.read("page_records").select(*[f.name for f in TABLES["page_records"]])
    moved = []
    for _ in range(2):
        before = shuffled(spark)
        log.run(lambda own: M.add_pages(own, none, assets, images))
        moved.append(shuffled(spark) - before)
    assert moved[0] < 5_000_000 and moved[1] < 200_000  # of 4 MB of contents, copies included
    assert log.read("images").count() == 100


def test_results_of_a_lease_are_asked_for_once(spark, tmp_path):
    """records are read for their rows, and no more when the pages change."""
    log = filled(spark, tmp_path)
    held = M.lease(log)
    rows = held.held().select("page_id", F.lit("mock").alias("provider"), F.lit("m").alias("model_name"), F.lit("{}").alias("result_json")).where("page_id < '2'")
    spark.createDataFrame(rows.collect(), rows.schema).write.parquet(f"{tmp_path}/records")
    seen, times = watched(spark.read.parquet(f"{tmp_path}/records"), f"{tmp_path}/times")
    late = M.succeed(held, seen).result
    assert times() == 1 and late.isEmpty()
    assert log.current("page_records").where("status = 'analyzed'").count() == 4 and log.current("analysis_results").count() == 4


def test_failures_of_a_lease_are_found_once(spark, tmp_path):
    """errors, results and pages come from one look at the failures."""
    log = filled(spark, tmp_path)
    held = M.lease(log)
    rows = spark.createDataFrame([("1_1", "no_answer", "m", None, None), ("1_2", M.LEASE_LOST, "m", None, None)], "page_id string, code string, message string, provider string, model_name string")
    seen, times = watched(rows, f"{tmp_path}/times")
    unkept = M.fail(held, seen).result
    assert times() == 1 and [r.page_id for r in unkept.collect()] == ["1_2"]
    assert log.read("errors").count() == 1 and log.current("page_records").where("status = 'failed'").count() == 1


def test_search_without_an_index_reads_texts_once(spark):
    """the statistics and the scores come from one exchange."""
    docs = spark.range(200).select(F.col("id").cast("string").alias("page_id"), F.when(F.col("id") % 3 == 0, "the cat and").otherwise("none of it").alias("body"))
    got = search.rank_texts(docs, search.parse("the and"))
    assert len(got.collect()) == 67
    assert "ReusedExchange" in plan(got)

"""Index versions: the active pointer, staleness, and rebuilds that never harm the index in use."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.operators import grammar, positions, search
from foliograph.schemas import ANALYZER_VERSION
from foliograph.sources.commits import hadoop, replace_file


class IndexProblem(RuntimeError):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


def status(versions: DataFrame, active: DataFrame, pages: DataFrame, documents: DataFrame, healthy: bool = True) -> DataFrame:
    """The index's state in one row, read only: each side is one aggregate."""
    v = versions.agg(F.count_if(F.col("status") == "building").alias("building"), F.count_if(F.col("status") == "failed").alias("failed"), F.max(F.when(F.col("status") == "failed", F.col("version_id"))).alias("last_failed"))
    a = active.join(versions.where("status = 'ready'").select("version_id", "document_count"), "version_id").agg(F.max("version_id").alias("active_version"), F.coalesce(F.max("document_count"), F.lit(0)).alias("indexed"))
    pointer = active.agg((F.count(F.lit(1)) > 0).alias("pointer"))
    p = pages.agg(F.count_if(F.col("status") == "analyzed").alias("analyzed"))
    d = documents.agg(F.count(F.lit(1)).alias("indexable"))
    one = v.crossJoin(a).crossJoin(pointer).crossJoin(p).crossJoin(d)  # five single rows
    has = F.col("active_version").isNotNull()
    state = F.when(has & F.lit(not healthy), "failed").when(F.col("building") > 0, "building").when(has, "ready").when(F.col("pointer"), "needs_rebuild").when(F.col("failed") > 0, "failed").otherwise("not_built")
    one = one.withColumn("status", state).withColumn("pending", F.greatest(F.col("indexable") - F.col("indexed"), F.lit(0))).withColumn("skipped", F.greatest(F.col("analyzed") - F.col("indexed"), F.lit(0)))
    can_search = (F.col("status") == "ready") | (has & (F.col("status") == "building"))
    one = one.withColumn("stale", F.col("pending") > 0).withColumn("can_search", can_search).withColumn("can_rebuild", (F.col("building") == 0) & (F.col("indexable") > 0))
    return one.withColumn("search_uses_stale_index", F.col("can_search") & F.col("stale")).select("status", "active_version", "indexed", "indexable", "analyzed", "pending", "skipped", "stale", "can_search", "can_rebuild", "search_uses_stale_index", "last_failed")


def read_pointer(spark: SparkSession, root: str) -> dict | None:
    """None if there is none; a broken one is an error."""
    fs, path = hadoop(spark, f"{root}/active.json")
    if not fs.exists(path):
        return None
    try:
        found = json.loads(spark.read.text(f"{root}/active.json", wholetext=True).first()[0])
        return {"version_id": found["version_id"], "directory": found["directory"], "documents": found["documents"]}
    except (ValueError, KeyError, TypeError) as e:
        raise IndexProblem("index_pointer_invalid", str(e)) from e


def write_pointer(spark: SparkSession, root: str, pointer: dict) -> None:
    replace_file(spark, f"{root}/active.json", json.dumps(pointer))


@dataclass
class Index:
    """postings (token, page_id, tf, positions), lengths (page_id, length and the exact fields), tokens (token, df)."""

    postings: DataFrame
    lengths: DataFrame
    tokens: DataFrame
    documents: int
    average: float

    def rank(self, tree: object) -> DataFrame:
        return positions.rank(self.postings, self.lengths, tree, counted=self.tokens)


#: What an index keeps of a page beside its text.
FIELDS = {"page_id": "string", "document_id": "string", "original_filename": "string", "image_path": "string", "page_number": "bigint"}


def stage(docs: DataFrame, directory: str) -> DataFrame:
    """The documents, written once; everything of a build reads them there."""
    have = docs.columns
    docs.select(*[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in FIELDS.items()], "body").write.mode("overwrite").parquet(f"{directory}/staged")
    return docs.sparkSession.read.parquet(f"{directory}/staged")


#: Parts that a token's postings are dealt out to by their pages, so that a frequent token does not lie in one task.
SPLIT = 32


def build(docs: DataFrame, directory: str) -> int:
    """Write postings sorted by token, so that a search skips all row groups but its tokens'; a frequent token is split by page."""
    spark = docs.sparkSession
    # dealt out by hash: ranges would be sampled first, for which all postings would be made twice
    post = positions.postings(docs).repartition("token", F.pmod(F.xxhash64("page_id"), F.lit(SPLIT)))
    post.sortWithinPartitions("token", "page_id").write.mode("overwrite").parquet(f"{directory}/postings")
    counted = spark.read.parquet(f"{directory}/postings").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    counted.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{directory}/tokens")
    length = F.greatest(F.length(F.lower("body")) - 1, F.lit(0)).cast("long").alias("length")
    docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast(kind).alias(c) for c, kind in FIELDS.items()], length).write.mode("overwrite").parquet(f"{directory}/lengths")
    spark.read.parquet(f"{directory}/lengths").agg(F.count(F.lit(1)).alias("documents"), F.avg("length").alias("average"), F.lit(ANALYZER_VERSION).alias("analyzer")).coalesce(1).write.mode("overwrite").parquet(f"{directory}/corpus")
    return spark.read.parquet(f"{directory}/corpus").first()["documents"]


SCHEMA = {
    "postings": [("token", "string"), ("page_id", "string"), ("tf", "bigint"), ("positions", "binary")],
    "lengths": [*FIELDS.items(), ("length", "bigint")],
    "tokens": [("token", "string"), ("df", "bigint")],
}


def open_index(spark: SparkSession, directory: str) -> Index:
    """Missing, differing and empty indexes are errors."""
    fs, path = hadoop(spark, f"{directory}/corpus")
    if not fs.exists(path):
        raise IndexProblem("index_not_found", directory)
    parts = {name: spark.read.parquet(f"{directory}/{name}") for name in SCHEMA}
    for name, wanted in SCHEMA.items():
        if parts[name].dtypes != wanted:
            raise IndexProblem("index_schema_mismatch", name)
    corpus = spark.read.parquet(f"{directory}/corpus").first()
    if not corpus["documents"]:
        raise IndexProblem("index_empty", directory)
    return Index(parts["postings"], parts["lengths"], parts["tokens"], corpus["documents"], corpus["average"])


def rebuild(docs: DataFrame, root: str, version_id: str) -> dict:
    """Build, check, probe, then switch; whatever fails before the switch leaves the old index in use."""
    directory = f"{root}/build-{version_id}"
    pointer = prepare(docs, directory, version_id)
    write_pointer(docs.sparkSession, root, pointer)
    return pointer


def prepare(docs: DataFrame, directory: str, version_id: str) -> dict:
    """An index that has been opened and asked, and the pointer that would make it the active one."""
    spark = docs.sparkSession
    staged = stage(docs, directory)
    n = build(staged, directory)
    index = open_index(spark, directory)
    first = staged.select(F.min_by("body", "page_id")).first()[0].split("\n")[0]
    word = next((w for w in first.split() if len(w) > 1 and w.isalnum()), None)
    if word and index.rank(grammar.Word(word)).isEmpty():
        raise IndexProblem("index_probe_failed", word)
    fs, path = hadoop(spark, f"{directory}/staged")
    fs.delete(path, True)
    return {"version_id": version_id, "directory": directory, "documents": n}

"""Exact deduplication as a stateful stream.

Documents' digests stream through keyed state that never expires and lives on
disk (RocksDB, checkpointed to a shared folder): for every digest it keeps the
stable identifier of the document that stays, the locator of its content (file
and row) and how many documents came.  Digests that came more than once are
hits; the full normalised bytes of their documents are compared, and only
documents whose bytes agree form a group.

:func:`deduplicate` streams one table and drops the state afterwards.
:func:`extend` keeps the state at a folder of the caller and goes on from it
with every new table; what came earlier is fetched by its locator.

The state is updated by aggregation, which combines copies before they move.
Texts move only if their digest may be a hit (a filter of fixed size says so),
and equal ones are combined first, so a group that holds a third of all rows
costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm.common import bits_of, cut, join_counted, located, new_path, sorted_out, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Megabytes of one state store's write buffer, and of all stores of an executor; what is beyond lies on disk.
STORE_BUFFER_MB, STORES_MB = "8", "128"
#: Micro-batches that a stored table is streamed in.
BATCHES = 3


def normalised(text: str = "text"):
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def sha256(c):
    return F.sha2(c, 256)


def state_of(stream: DataFrame) -> DataFrame:
    """The keyed state over a stream of (digest, doc_id, locator): never expires."""
    top = F.max(F.struct("doc_id", "locator"))
    return stream.groupBy("digest").agg(F.count(F.lit(1)).alias("came"), top["doc_id"].alias("stays"), top["locator"].alias("locator"))


def stream_state(spark: SparkSession, path: str, schema, checkpoint: str, log: str) -> DataFrame:
    """Stream the files under ``path`` that the checkpoint has not seen through the state; the state after the last batch."""
    files, kept = spark.read.schema(schema).parquet(path).inputFiles(), {}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-len(files) // BATCHES))).parquet(path)
    rocks = "spark.sql.streaming.stateStore.rocksdb"
    options = {
        "spark.sql.streaming.stateStore.providerClass": ROCKS,
        f"{rocks}.changelogCheckpointing.enabled": "true",
        f"{rocks}.allowFAllocate": "false",
        # an executor holds many small stores: small buffers for each, one bounded cache for all
        f"{rocks}.writeBufferSizeMB": STORE_BUFFER_MB,
        f"{rocks}.boundedMemoryUsage": "true",
        f"{rocks}.maxMemoryUsageMB": STORES_MB,
        # stores of an ended stream are closed by the next maintenance
        "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
        "spark.sql.streaming.minBatchesToRetain": "2",
    }
    for k, v in options.items():
        kept[k] = spark.conf.get(k, None)
        spark.conf.set(k, v)
    try:
        query = (
            state_of(stream).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint)
            .foreachBatch(lambda changed, batch: changed.write.mode("overwrite").parquet(f"{log}/batch={batch}")).start()
        )
        query.awaitTermination()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return last_state(spark, log, state_of(spark.createDataFrame([], schema)).schema)


def last_state(spark: SparkSession, log: str, schema) -> DataFrame:
    """The newest update of every digest: it counts all that came before."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    updates = spark.read.schema(schema).parquet(log)
    return updates.groupBy("digest").agg(F.max_by(F.struct("came", "stays", "locator"), "came").alias("s")).select("digest", "s.*")


def deduplicate(df: DataFrame, text: str = "text", doc_id: str = "doc_id", digest=sha256) -> DataFrame:
    """One row for each row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z only; null
    counts as empty.  Of equal texts the row with the largest doc_id stays,
    null ids last; exactly one row of a group is kept, also where rows repeat
    their id.  Other columns are not read, whatever their names.  An empty
    table gives an empty result.
    """
    return _verdicts(located(df, False, _doc=F.col(doc_id), _text=normalised(text)), digest).select(
        "doc_id", F.col("stays").alias("keep_id"), F.col("came").alias("group_size"), (F.col("locator") == F.col("top")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def _verdicts(rows: DataFrame, digest=sha256) -> DataFrame:
    """(doc_id, digest, locator, came, stays, top) of every row; top is the locator of the row that stays."""
    spark = rows.sparkSession
    digests = rows.select(F.col("_doc").alias("doc_id"), digest(F.col("_text")).alias("digest"), F.col("_place").alias("locator"))
    path = new_path(spark, "dedup-digests")
    digests.write.parquet(path)
    digests = spark.read.schema(digests.schema).parquet(path)
    state = cut(stream_state(spark, path, digests.schema, new_path(spark, "dedup-state"), new_path(spark, "dedup-updates")), "dedup-last")
    n = digests.count()
    known = state.select("digest", "came", "stays", F.col("locator").alias("top"))
    clash = cut(_clashes(rows.withColumn("digest", digest(F.col("_text"))), known), "dedup-clashes")
    if clash.isEmpty():
        return join_counted(digests, known, ["digest"], "came", n)
    # one digest, different bytes: such texts are grouped for themselves
    own = rows.withColumn("digest", digest(F.col("_text"))).join(clash, "digest", "left_semi")
    top = F.max(F.struct(F.col("_doc").alias("d"), F.col("_place").alias("p")))
    groups = own.groupBy("digest", "_text").agg(F.count(F.lit(1)).alias("came"), top.alias("t")).select("digest", "_text", "came", F.col("t.d").alias("stays"), F.col("t.p").alias("top"))
    apart = join_counted(own.select(F.col("_doc").alias("doc_id"), "digest", F.col("_place").alias("locator"), "_text"), groups, ["digest", "_text"], "came", n).drop("_text")
    return join_counted(digests.join(clash, "digest", "left_anti"), known.join(clash, "digest", "left_anti"), ["digest"], "came", n).unionByName(apart)


def _clashes(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Digests of hits that stand for more than one text: full bytes are compared, equal copies combined before they move."""
    hits = known.where("came > 1")
    maybe = sorted_out(rows.select("digest", "_text"), bits_of(hits, "digest"), "digest").where("_maybe")
    texts = maybe.groupBy("digest", "_text").agg(F.count(F.lit(1)).alias("n"))
    return texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stay, exactly one of each group of equal texts, with all their columns.

    Null texts count as empty and are one group; of equal rows with one id, or
    with null ids, one stays.  Columns may have any name.  An empty table gives
    an empty result.  Only rows whose digest may have come more than once are
    shuffled.
    """
    rows = located(df, True, _doc=F.col(doc_id), _text=normalised(text))
    verdicts = _verdicts(rows.select("_doc", "_text", "_place"))
    gone = cut(verdicts.where("locator <> top").select(F.col("locator").alias("_place")), "dedup-gone")
    return without(rows, gone)


def extend(df: DataFrame, home: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Deduplicate ``df`` against all that earlier calls brought to ``home``: one row for each of its rows, as of now.

    ``home`` is a folder that outlives the session; it holds the digests, the
    checkpoint of the keyed state and its updates.  ``df`` comes from Parquet
    files that stay where they are, so that later calls can fetch contents by
    their locators (a table that comes from elsewhere is written there first).
    A row is a copy only if its bytes are those of the content fetched; a row
    whose digest agrees and whose bytes do not is kept.
    """
    spark = df.sparkSession
    rows = located(df, False, home=f"{home}/contents", _doc=F.col(doc_id), _text=normalised(text))
    digests = cut(rows.select(F.col("_doc").alias("doc_id"), sha256(F.col("_text")).alias("digest"), F.col("_place").alias("locator")), "dedup-new")
    log, schema = f"{home}/updates", digests.schema
    before = cut(last_state(spark, log, state_of(digests.limit(0)).schema), "dedup-before")
    digests.write.mode("append").parquet(f"{home}/digests")
    after = cut(stream_state(spark, f"{home}/digests", schema, f"{home}/state", log), "dedup-after")
    own = rows.withColumn("digest", sha256(F.col("_text")))
    met = before.join(digests.select("digest").distinct(), "digest", "left_semi").select("digest", F.col("locator").alias("_place"))
    other = own.select("digest", "_text", F.lit(True).alias("same")).limit(0)
    paths = [r[0] for r in met.select(F.substring_index("_place", "#", 1)).distinct().collect()]  # files, not documents
    if paths:
        old = spark.read.parquet(*paths)
        content = F.col("_text") if "_text" in old.columns else normalised(text)
        place = F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string"))
        other = old.select(content.alias("_text"), place.alias("_place")).join(met, "_place").select("digest", "_text", F.lit(True).alias("same"))
    seen = before.select("digest", F.lit(True).alias("known"))
    judged = own.join(seen, "digest", "left").join(other, ["digest", "_text"], "left")
    judged = judged.select(F.col("_doc").alias("doc_id"), "digest", F.col("_place").alias("locator"), (F.col("known").isNotNull() & F.col("same").isNull()).alias("apart"))
    total = after.agg(F.coalesce(F.sum("came"), F.lit(0))).first()[0]
    found = join_counted(judged, after.select("digest", "came", "stays", F.col("locator").alias("top")), ["digest"], "came", total)
    mine = lambda c, own: F.when(F.col("apart"), own).otherwise(F.col(c))
    return found.select("doc_id", mine("stays", F.col("doc_id")).alias("keep_id"), mine("came", F.lit(1)).cast("long").alias("group_size"), (F.col("apart") | (F.col("locator") == F.col("top"))).alias("kept"), F.col("digest").alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""

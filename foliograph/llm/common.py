"""What several operators share: the shared folder, written tables, checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of a join up to this many rows and bytes of key text are broadcast.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 4_000_000
#: Bits of the filters that keep rows without a partner from moving; their size does not follow the corpus.
FILTER_BITS = 1 << 22
#: Bytes after which an Arrow batch on its way to Python ends.  At Spark's 64 MB a batch is a whole split of texts, held
#: by the JVM outside its heap and by the worker; the setting moves no rows and changes no result.
BATCH_BYTES = "4m"


_held: dict = {}


def held(owner: str) -> dict:
    """What a worker keeps from one task to the next, of one operator at a time: who comes next finds the others' gone."""
    if owner not in _held:
        _held.clear()
    return _held.setdefault(owner, {})


def give_back() -> None:
    """Return freed memory to the system; a worker waits for its next task beside the JVM, whatever runs there meanwhile."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(run):
    """``run``, a function over the batches of a partition, gives its memory back when the partition is done."""

    @functools.wraps(run)
    def own(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on a local master (tests on one machine) a temporary folder is made
    where the session names none; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = made.get() if made.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="foliograph-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Set BATCH_BYTES for the session, unless it has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64MB"):
        spark.conf.set(name, BATCH_BYTES)


def new_path(spark: SparkSession, name: str) -> str:
    """A path for one written table, removed when the driver ends."""
    bound_batches(spark)
    path = f"{shared_dir(spark)}/foliograph/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session may be gone already
            pass

    atexit.register(remove)
    _removers[path] = remove
    return path


_removers: dict = {}


def forget(path: str) -> None:
    """Remove a written table that nothing reads any more."""
    remove = _removers.pop(path, None)
    if remove:
        atexit.unregister(remove)
        remove()


def packed(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``df``, which has about ``rows`` rows, in no more partitions than that takes; never in more than it has."""
    return df.coalesce(max(1, -(-rows // each)))


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The written table ends the lineage, and it outlives any executor.  Where
    the caller can bound its rows, it is written in as few files as they fill.
    """
    path = new_path(df.sparkSession, name)
    (df if rows is None else packed(df, rows)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(df: DataFrame, small: DataFrame, key: str, how: str = "inner", salts: int = 32, size=None) -> DataFrame:
    """Join ``small`` (one row a key, non-null string keys) to ``df``, whose keys may be very uneven.

    ``small`` is broadcast when it has at most BROADCAST_ROWS rows and
    BROADCAST_BYTES of keys (and of ``size``, the bytes of its other columns,
    where these may be long).  Beyond that both sides are dealt out by key and
    salt, so that a hot key lands in ``salts`` tasks.
    """
    bulk = F.octet_length(key) if size is None else F.octet_length(key) + size
    n, total = small.agg(F.count(F.lit(1)), F.coalesce(F.sum(bulk), F.lit(0))).first()
    if n <= BROADCAST_ROWS and total <= BROADCAST_BYTES:
        return df.join(F.broadcast(small), key, how)
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c, t in df.dtypes if t in ("bigint", "string", "int")]), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def join_counted(df: DataFrame, small: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``small``, one row a key, to ``df``; ``weight`` bounds a key's rows in ``df``, ``total`` the sum of all weights.

    Fewer than BROADCAST_ROWS keys can each have more than that part of the
    total.  These are broadcast, so their rows never meet in one task; the rows
    of all other keys are shuffled.
    """
    often = F.col(weight) * BROADCAST_ROWS > total
    hot, cold = F.broadcast(small.where(often)), small.where(~often)
    return df.join(hot, keys).unionByName(df.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def bits_of(keys: DataFrame, key) -> DataFrame:
    """A filter of fixed size that knows the keys: w, b (FILTER_BITS / 64 rows at most)."""
    bit = keys.select(F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)).alias("bit"))
    words = bit.selectExpr("bit div 64 AS w", "shiftleft(1L, cast(bit % 64 AS int)) AS b").groupBy("w").agg(F.expr("bit_or(b)").alias("b"))
    return words.coalesce(8)


def sorted_out(df: DataFrame, bits: DataFrame, key: str) -> DataFrame:
    """``df`` with ``_maybe``: false where the key is none that the filter knows.  Nothing is shuffled."""
    at = df.withColumn("_bit", F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))).withColumn("_w", F.expr("_bit div 64"))
    own = F.broadcast(bits.select(F.col("w").alias("_w"), F.col("b").alias("_b")))
    found = F.expr("coalesce(shiftright(_b, cast(_bit % 64 AS int)) & 1, 0) = 1")
    return at.join(own, "_w", "left").withColumn("_maybe", found).drop("_w", "_bit", "_b")


def located(df: DataFrame, whole: bool = True, home: str | None = None, **columns) -> DataFrame:
    """``_row`` (all columns of ``df``; if asked for), the columns given, and ``_place``, which names one row for good.

    The place is file and row number.  What does not come straight from files
    is written first, to ``home`` where it shall stay.  Names of ``df`` cannot clash with those made here.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")] if whole else []
    made = [c.alias(name) for name, c in columns.items()]
    place = F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string")).alias("_place")
    if "_metadata" not in df.columns:
        try:
            return df.select(*row, *made, place)
        except Exception:  # no file scan
            pass
    if home is None:
        written = cut(df.select(*row, *made), "rows")
    else:
        path = f"{home}/{uuid.uuid4().hex}"
        df.select(*row, *made).write.parquet(path)
        written = df.sparkSession.read.parquet(path)
    return written.select(*written.columns, place)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The columns of located rows whose ``_place`` is not in ``gone``; only rows that the filter cannot clear are shuffled."""
    seen = sorted_out(rows.select("_row", "_place"), bits_of(gone, "_place"), "_place")
    left = seen.where("NOT _maybe").select("_row").unionByName(seen.where("_maybe").join(gone, "_place", "left_anti").select("_row"))
    return left.select("_row.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def some(x) -> bool:
    """Whether a cell taken from pandas holds a value."""
    return x is not None and x == x

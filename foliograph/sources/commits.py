"""The ledger as a log of commits over Parquet files.

Rows are written first, under a name that nobody knows; a numbered commit file
then makes them visible, all tables' together or none.  A number can be taken
once (put-if-absent), so commits are in one order; who comes second looks at
what was committed since it began to read and goes on if nothing of it touches
what it has read, or begins anew.

- ``Transaction.reads`` and ``Transaction.add`` keep a bit for each of BUCKETS
  groups of keys, so most commits are told apart by comparing a few hundred
  bytes, however many rows were read; where bits meet, the keys are compared.
- A commit carries its writer's batch number; a batch that comes again adds
  nothing.
- Rows of a commit are numbered without gaps: the number of its first row, what
  earlier partitions hold, and the place in the partition.  Nothing is sorted.
- Deleted rows stay in their files; bits by file and row number hide them.
- ``compact`` puts one table's files together, for state tables only the newest
  row of each key, so folds read a snapshot and the tail after it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.schemas import KEYS, MIGRATIONS, TABLES, columns_at, lifted

#: Groups of keys that conflicts are told apart by.
BUCKETS = 4096
#: Commits after which the state is written down, so that readers begin there.
SNAPSHOT_EVERY = 32
#: Attempts of :meth:`Log.run`.
ATTEMPTS = 20
#: Columns that the log adds: the commit of a row, its number, and its place in its partition.
VERSION, NUMBER, PLACE = "_version", "_number", "_place"
_IN_PARTITION = (1 << 33) - 1
#: Columns by which rows are looked up, beside a table's key.
LOOKED_UP = {"errors": ("correlation_id",), "documents": ("file_hash",), "index_versions": ("error_id",)}
#: A part of up to so many rows has a Bloom filter of these columns in its commit, of BLOOM_BITS bits a row and HASHES
#: hashes; larger ones have their columns' ranges there, and Parquet's own filters in their files.
BLOOM_ROWS, BLOOM_BITS, HASHES = 10_000, 10, 7


class Conflict(RuntimeError):
    """Something that was read has been changed since."""

    code = "ledger_conflict"


def hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_file(spark: SparkSession, path: str) -> str:
    fs, p = hadoop(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Written under a name of its own and renamed over the old file, in one step; two writers never share a staged file."""
    fs, p = hadoop(spark, path)
    _, staged = hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    over = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(over, 1)
    how[0] = over.OVERWRITE
    at = p.makeQualified(fs.getUri(), fs.getWorkingDirectory())
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(staged.makeQualified(fs.getUri(), fs.getWorkingDirectory()), at, how)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this call made the file; readers see all of it or nothing.

    On a local file system by a hard link, elsewhere by a rename that does not
    replace, which the file system has to do in one step (as HDFS does).
    """
    fs, p = hadoop(spark, path)
    fs.mkdirs(p.getParent())
    staged = f"{path}.{uuid.uuid4().hex}"
    _, s = hadoop(spark, staged)
    out = fs.create(s, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.getUri().getScheme() == "file":
        try:
            os.link(s.toUri().getPath(), p.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(s, False)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    how = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    at = p.makeQualified(fs.getUri(), fs.getWorkingDirectory())
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(s.makeQualified(fs.getUri(), fs.getWorkingDirectory()), at, how)
        return True
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        fs.delete(s, False)
        return False


def buckets(df: DataFrame, key: str | Column) -> int:
    """The groups that the keys fall into, BUCKETS at most, as the bits of one number."""
    return sum(1 << b for b in df.agg(F.collect_set(F.pmod(F.xxhash64(key), F.lit(BUCKETS)))).first()[0])


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that the planner knows, of numbers and hexadecimal names; many of them come from the driver as usual."""
    if len(rows) > 2_000:
        return spark.createDataFrame(rows, schema).coalesce(1)
    cells = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    fields = [f.split() for f in schema.split(", ")]
    return spark.sql(f"SELECT {', '.join(f'cast({n} AS {kind}) AS {n}' for n, kind in fields)} FROM VALUES {cells} AS t({', '.join(n for n, _ in fields)})")


def _told(df: DataFrame, key: str, columns: tuple, rows: int) -> tuple[int, dict]:
    """The groups of a part's keys, and of the columns the ranges and Bloom filters, in one pass."""
    columns = tuple(c for c in columns if dict(df.dtypes)[c] == "string")
    bits = BLOOM_BITS * rows if rows <= BLOOM_ROWS else 0
    asked = [F.collect_set(F.pmod(F.xxhash64(key), F.lit(BUCKETS)))]
    for c in columns:
        at = F.array(*[F.pmod(F.pmod(F.xxhash64(c), F.lit(bits)) + k * F.pmod(F.xxhash64(c, F.lit(1)), F.lit(bits)), F.lit(bits)) for k in range(HASHES)]) if bits else F.array(F.lit(0))
        asked += [F.min(c), F.max(c), F.collect_set(F.when(F.col(c).isNotNull(), at))]
    found = df.agg(*[x.alias(f"c{k}") for k, x in enumerate(asked)]).first()
    told = {}
    for k, c in enumerate(columns):
        least, most, places = found[1 + 3 * k : 4 + 3 * k]
        told[c] = {"least": least, "most": most}
        if bits:
            told[c] |= {"bits": bits, "bloom": f"{sum(1 << p for p in {p for own in places for p in own}):x}"}
    return sum(1 << b for b in found[0]), told


@dataclass
class State:
    """What a reader needs of all commits up to one: the live parts of each table, batches done, numbers given, files to remove."""

    version: int = 0
    parts: dict[str, dict[str, dict]] = field(default_factory=dict)
    hidden: dict[str, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    numbers: dict[str, int] = field(default_factory=dict)
    gone: list[str] = field(default_factory=list)

    def apply(self, commit: dict) -> None:
        self.version = commit["version"]
        for table, adds in commit["adds"].items():
            for part, told in adds.items():
                own = dict(told)
                if not own.pop("kept_numbers", False):
                    own["first"] = self.numbers.get(table, 0)
                    self.numbers[table] = own["first"] + own["rows"]
                self.parts.setdefault(table, {})[part] = own | {"version": self.version}
        for table, parts in commit["removes"].items():
            for part in parts:
                del self.parts[table][part]
            self.hidden.pop(table, None)  # what was hidden is not in the parts that replace them
        for table, names in commit["hides"].items():
            self.hidden.setdefault(table, []).extend(names)
        if commit.get("writer") is not None:
            self.batches[commit["writer"]] = commit["batch"]
        self.gone = [n for n in self.gone + commit["told"].get("gone", []) if n not in commit["told"].get("removed", [])]


class Log:
    """The ledger under ``root``."""

    def __init__(self, spark: SparkSession, root: str, migrations: tuple = MIGRATIONS):
        self.spark, self.root, self.migrations = spark, f"{root.rstrip('/')}/ledger", migrations
        self.generation = max(m.version for m in migrations)
        self.folder = f"{self.root}/_commits"
        self._commits: dict[int, dict] = {}
        self._state = State()

    def _name(self, version: int) -> str:
        return f"{self.folder}/{version:020d}.json"

    def _newest(self) -> tuple[int, int]:
        """The highest commit, and the highest of which the state is written down."""
        fs, p = hadoop(self.spark, self.folder)
        if not fs.exists(p):
            return 0, 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        pick = lambda end: max((int(n[:20]) for n in names if n[20:] == end), default=0)
        return pick(".json"), pick(".state")

    def commit_at(self, version: int) -> dict:
        if version not in self._commits:
            self._commits[version] = json.loads(read_file(self.spark, self._name(version)))
        return self._commits[version]

    def state(self, version: int | None = None) -> State:
        """The state now, or after an earlier commit."""
        newest, written = self._newest()
        upto = newest if version is None else version
        state = State()
        if written and written <= upto:
            if self._state.version == written:
                state = self._copy(self._state)
            else:
                state = State(**json.loads(read_file(self.spark, self._name(written).replace(".json", ".state"))))
                self._state = self._copy(state)
        for v in range(state.version + 1, upto + 1):
            state.apply(self.commit_at(v))
        return state

    @staticmethod
    def _copy(state: State) -> State:
        return State(**json.loads(json.dumps(state.__dict__)))

    def part(self, table: str, part: str) -> str:
        return f"{self.root}/{table}/part={part}"

    def migrate(self, now: str | None = None) -> list[int]:
        """Record the generations that are not recorded yet, in order; returns them.  Old files stay: readers lift them."""

        def work(own: Transaction) -> list[int]:
            done = {r[0] for r in own.read("schema_migrations").select("version").collect()}
            new = sorted((m.version, m.name) for m in self.migrations if m.version not in done)
            if new:
                at = F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
                own.add("schema_migrations", _small(self.spark, new, "version long, name string").withColumn("applied_at", at), guards=("schema_migrations",))
            return [v for v, _ in new]

        return self.run(work).result

    def candidates(self, table: str, column: str, value: str, state: State | None = None) -> list[str]:
        """The live parts that may hold a value, by their ranges and Bloom filters; nothing of the table is read."""
        state = state or self.state()
        h1, h2 = self.spark.range(1).select(F.xxhash64(F.lit(value)), F.xxhash64(F.lit(value), F.lit(1))).first()
        found = []
        for part, told in state.parts.get(table, {}).items():
            own = told.get("columns", {}).get(column)
            if own is not None:
                if own["least"] is None or not own["least"] <= value <= own["most"]:
                    continue
                bits = own.get("bits")
                if bits:
                    held = int(own["bloom"], 16)
                    if any(not held >> ((h1 % bits + k * (h2 % bits)) % bits) & 1 for k in range(HASHES)):
                        continue
            found.append(part)
        return found

    def lookup(self, table: str, column: str, value: str, state: State | None = None) -> DataFrame:
        """The rows with a value, from the parts that may hold it."""
        state = state or self.state()
        return self.read(table, state, only=self.candidates(table, column, value, state)).where(F.col(column) == value)

    def read(self, table: str, state: State | None = None, after: int = 0, places: bool = False, only: list[str] | None = None) -> DataFrame:
        """The live rows of a table with the commit and the number of each; of commits after ``after`` only, of the parts ``only``.

        ``places`` adds _file and _row, which :meth:`Transaction.hide` takes.
        Parts of older generations are read as they were written, and lifted.
        """
        state = state or self.state()
        live = {p: told for p, told in state.parts.get(table, {}).items() if told["version"] > after and (only is None or p in only)}
        names = [f.name for f in TABLES[table]]
        extra = f"{VERSION} long, {NUMBER} long" + (", _file string, _row long" if places else "")
        if not live:
            return self.spark.sql("SELECT " + ", ".join(f"cast(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in TABLES[table])).limit(0).select("*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in extra.split(", ")])
        generations: dict[int, list[str]] = {}
        for p, told in live.items():
            generations.setdefault(told.get("generation", self.generation), []).append(p)
        own = [PLACE, VERSION, NUMBER, "part", "_file", "_row"]
        scans = []
        for version, parts in sorted(generations.items()):
            columns = columns_at(table, version, self.migrations)
            schema = ", ".join(f"`{n}` {k}" for n, k in columns) + f", {PLACE} long, {VERSION} long, {NUMBER} long, part string"
            scan = self.spark.read.option("basePath", f"{self.root}/{table}").schema(schema).parquet(*[self.part(table, p) for p in parts])
            scan = scan.select(*[n for n, _ in columns], PLACE, VERSION, NUMBER, "part", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
            scans.append(lifted(scan, table, version, self.migrations).select(*names, *own))
        rows = reduce(DataFrame.unionByName, scans)
        if state.hidden.get(table):
            bits = self.spark.read.parquet(*[f"{self.root}/{table}/_hidden/{x}" for x in state.hidden[table]]).groupBy("_file", "_word").agg(F.expr("bit_or(bits)").alias("_bits"))
            rows = rows.withColumn("_word", F.floor(F.col("_row") / 64)).join(bits, ["_file", "_word"], "left").where("_bits IS NULL OR (shiftright(_bits, cast(_row % 64 AS int)) & 1) = 0")
        # as many rows as the live parts have partitions
        told = [(p, int(k), x["version"], x["first"] + n) for p, x in live.items() for k, n in x.get("starts", {"0": 0}).items()]
        starts = _small(self.spark, told, "part string, _at int, _commit long, _first long")
        at = F.shiftright(PLACE, 33).cast("int").alias("_at")
        rows = rows.withColumn("_at", at).join(starts, ["part", "_at"])
        number = F.coalesce(NUMBER, F.col("_first") + F.col(PLACE).bitwiseAND(F.lit(_IN_PARTITION)))
        rows = rows.select(*names, F.coalesce(VERSION, "_commit").alias(VERSION), number.alias(NUMBER), *(["_file", "_row"] if places else []))
        return rows.where(F.col(VERSION) > after) if after else rows  # a compacted part holds older rows too

    def current(self, table: str, state: State | None = None) -> DataFrame:
        """The newest row of each key, with its commit (_version); combined before anything moves."""
        rows = self.read(table, state)
        newest = F.max_by(F.struct(*rows.columns), F.struct(VERSION, NUMBER)).alias("row")
        return rows.groupBy(KEYS[table]).agg(newest).select("row.*").drop(NUMBER)

    def begin(self) -> Transaction:
        return Transaction(self, self.state())

    def run(self, work: Callable[[Transaction], object], writer: str | None = None, batch: int | None = None) -> Transaction | None:
        """``work`` on a transaction, committed; begun anew, on the state of the day, if it meets a conflict.

        Returns the transaction, with what ``work`` returned as its result.  Of
        a ``batch`` that its writer has committed already nothing is done (None):
        an append is made once however often it is tried.
        """
        for _ in range(ATTEMPTS):
            own = self.begin()
            if writer is not None and own.state.batches.get(writer, -1) >= batch:
                return None
            own.writer, own.batch = writer, batch
            own.result = work(own)
            try:
                own.commit()
                return own
            except Conflict:
                continue
        raise Conflict(f"gave up after {ATTEMPTS} attempts")

    def compact(self, table: str, newest_only: bool = True) -> int:
        """Put a table's live parts into one; with ``newest_only`` (state tables) one row a key.  Returns the commit."""

        def work(own: Transaction) -> None:
            parts = list(own.state.parts.get(table, {}))
            if not parts:
                return
            rows = self.read(table, own.state)
            if newest_only:
                rows = rows.groupBy(KEYS[table]).agg(F.max_by(F.struct(*rows.columns), F.struct(VERSION, NUMBER)).alias("row")).select("row.*")
            own._write(table, rows, kept_numbers=True)
            own.removes[table] = parts

        return self.run(work).version or 0

    def vacuum(self) -> list[str]:
        """Delete the files of parts that no commit names any more, or never did; returns their names.

        Only folders below the ledger are looked at, and only such that carry
        the log's own names; to be run when no writer is at work.
        """
        state, gone = self.state(), []
        fs, root = hadoop(self.spark, self.root)
        if not fs.exists(root):
            return gone
        _, once = hadoop(self.spark, f"{self.root}/_once")
        fs.delete(once, True)
        for table in TABLES:
            _, home = hadoop(self.spark, f"{self.root}/{table}")
            if not fs.exists(home):
                continue
            live = {f"part={p}" for p in state.parts.get(table, {})}
            for s in fs.listStatus(home):
                name = s.getPath().getName()
                if s.isDirectory() and name.startswith("part=") and name not in live:
                    fs.delete(s.getPath(), True)
                    gone.append(f"{table}/{name}")
        return gone


class Transaction:
    """Reads at one state, and writes that become visible together."""

    def __init__(self, log: Log, state: State):
        self.log, self.state, self.spark = log, state, log.spark
        self.adds: dict[str, dict[str, dict]] = {}
        self.removes: dict[str, list[str]] = {}
        self.hides: dict[str, list[str]] = {}
        self.read_bits: dict[str, int] = {}
        #: the keys behind the bits, for an exact look; None where the whole table was read
        self.read_keys: dict[str, list[DataFrame] | None] = {}
        self.touched: dict[str, int] = {}
        #: tables of which keys were touched whose rows stay as they are
        self.leaned: set[str] = set()
        self.writer: str | None = None
        self.batch: int | None = None
        self.version: int | None = None
        self.told: dict = {}
        self.result: object = None

    def read(self, table: str, **options) -> DataFrame:
        return self.log.read(table, self.state, **options)

    def current(self, table: str) -> DataFrame:
        return self.log.current(table, self.state)

    def once(self, df: DataFrame) -> DataFrame:
        """``df``, computed once and written down beside the tables, for what a transaction asks of it several times; vacuum removes it."""
        path = f"{self.log.root}/_once/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def added(self, table: str) -> DataFrame:
        """The rows that this transaction has added to a table so far."""
        parts = self.adds.get(table)
        if not parts:
            return self.read(table, only=[]).select(*[f.name for f in TABLES[table]])
        return self.spark.read.parquet(*[self.log.part(table, p) for p in parts]).select(*[f.name for f in TABLES[table]])

    def reads(self, table: str, keys: DataFrame | None = None) -> None:
        """This transaction depends on these keys (the first column) of a table, or on all of it."""
        self._rely(table, (1 << BUCKETS) - 1 if keys is None else buckets(keys, keys.columns[0]), keys)

    def _rely(self, table: str, bits: int, keys: DataFrame | None) -> None:
        self.read_bits[table] = self.read_bits.get(table, 0) | bits
        if keys is None:
            self.read_keys[table] = None
        elif self.read_keys.get(table, []) is not None:
            self.read_keys.setdefault(table, []).append(keys.select(F.col(keys.columns[0]).alias("key")))

    def add(self, table: str, rows: DataFrame, guards: tuple[str, ...] = ()) -> int:
        """Append rows (all of the table's columns); returns their number.

        ``guards`` are tables with the same keys: that these rows are right
        depends on what these tables say of the keys now.
        """
        names = [f.name for f in TABLES[table]]
        part = self._write(table, rows.select(*[F.col(n).cast(TABLES[table][n].dataType).alias(n) for n in names]))
        if part is None:
            return 0
        written = self.spark.read.parquet(self.log.part(table, part))
        bits, columns = _told(written, KEYS[table], (KEYS[table], *LOOKED_UP.get(table, ())), self.adds[table][part]["rows"])
        self.adds[table][part]["columns"] = columns
        self.touched[table] = self.touched.get(table, 0) | bits
        for guard in guards:
            self._rely(guard, bits, written.select(KEYS[table]))
        return self.adds[table][part]["rows"]

    def _write(self, table: str, rows: DataFrame, kept_numbers: bool = False) -> str | None:
        part = uuid.uuid4().hex
        path = self.log.part(table, part)
        place = F.lit(0).cast("long") if kept_numbers else F.monotonically_increasing_id()
        kept = [] if kept_numbers else [F.lit(None).cast("long").alias(x) for x in (VERSION, NUMBER)]
        rows.select("*", *kept, place.alias(PLACE)).write.option(f"parquet.bloom.filter.enabled#{KEYS[table]}", "true").parquet(path)
        written = self.spark.read.parquet(path)
        # as many rows as the write had partitions; the footers are not enough, as a task may write several files
        counts = sorted((r[0], r[1]) for r in written.groupBy(F.shiftright(PLACE, 33).cast("int")).count().collect())
        if not counts:
            return None
        starts, total = {}, 0
        for at, n in counts:
            starts[str(at)] = total
            total += n
        self.adds.setdefault(table, {})[part] = {"rows": total, "starts": starts, "generation": self.log.generation} | ({"kept_numbers": True, "first": 0} if kept_numbers else {})
        return part

    def touch(self, table: str, keys: DataFrame) -> None:
        """These keys (the first column) are relied upon by what is written here, though their rows stay as they are."""
        bits = buckets(keys, keys.columns[0])
        self.touched[table] = self.touched.get(table, 0) | bits
        self.leaned.add(table)
        self._rely(table, bits, keys)

    def hide(self, table: str, rows: DataFrame) -> int:
        """Delete rows that were read with their places; returns their number."""
        name = uuid.uuid4().hex
        path = f"{self.log.root}/{table}/_hidden/{name}"  # a folder that no scan of the table lists
        own = self.once(rows.select(F.col(KEYS[table]).alias("key"), "_file", "_row"))
        keys = buckets(own, "key")
        self.touched[table] = self.touched.get(table, 0) | keys
        self._rely(table, keys, own)
        bits = own.groupBy("_file", F.floor(F.col("_row") / 64).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_row % 64 AS int)))").alias("bits"))
        bits.write.parquet(path)
        n = self.spark.read.parquet(path).agg(F.sum(F.expr("bit_count(bits)"))).first()[0]
        if n:
            self.hides.setdefault(table, []).append(name)
        return n or 0

    def _overlaps(self, table: str, other: dict) -> bool:
        """Whether keys that fell into the same groups are the same keys: those read here, and those of the rows that the other commit wrote."""
        own = self.read_keys.get(table)
        if own is None or table in other["hides"] or table in other.get("leaned", []) or table not in other["adds"]:
            return True
        theirs = self.spark.read.parquet(*[self.log.part(table, p) for p in other["adds"][table]]).select(F.col(KEYS[table]).alias("key"))
        return not reduce(DataFrame.unionByName, own).join(theirs, "key", "left_semi").isEmpty()

    def _clashes(self, other: dict) -> str | None:
        for table, bits in self.read_bits.items():
            if int(other["touched"].get(table, "0"), 16) & bits and self._overlaps(table, other):
                return table
        for table in self.hides:
            if table in other["removes"]:
                return table
        for table in self.removes:
            if table in other["hides"] or table in other["removes"]:
                return table
        if self.writer is not None and other.get("writer") == self.writer and other["batch"] >= self.batch:
            return f"batch of {self.writer}"
        return None

    def commit(self) -> int:
        """The number under which all of it became visible; :class:`Conflict` if it must not."""
        log = self.log
        if not (self.adds or self.removes or self.hides or self.told):
            return self.state.version
        seen = self.state.version
        while True:
            newest, _ = log._newest()
            for v in range(seen + 1, newest + 1):
                table = self._clashes(log.commit_at(v))
                if table:
                    raise Conflict(f"{table} was changed by commit {v}")
            seen = newest
            commit = {"version": newest + 1, "adds": self.adds, "removes": self.removes, "hides": self.hides, "touched": {t: f"{b:x}" for t, b in self.touched.items()}, "writer": self.writer, "batch": self.batch, "told": self.told, "leaned": sorted(self.leaned)}
            if put_if_absent(self.spark, log._name(newest + 1), json.dumps(commit)):
                self.version = newest + 1
                if self.version % SNAPSHOT_EVERY == 0:
                    put_if_absent(self.spark, log._name(self.version).replace(".json", ".state"), json.dumps(log.state(self.version).__dict__))
                return self.version

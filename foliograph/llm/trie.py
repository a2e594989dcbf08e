"""Prefix trie of conversations, from the Cartesian tree over the LCP array of the sorted conversations.

Conversations are sorted by the sequence of their turns; L[s] is the number of
turns that the s-th shares with the one before it.  The trie's branching nodes
are the Cartesian tree's over L, equal values merged: that of s spans from the
nearest smaller value on its left (whose own conversation is the first member)
up to the nearest smaller value on its right.  The array is cut into blocks of
about the square root of its length.  A block finds the nearest smaller values
inside itself with a stack; for what is left it asks, of the blocks' minima,
which block holds the answer, and that block answers from its staircase of
minima.  So no task holds more than a block, or one question for each block and
depth.

All that is asked of a node is a sum or a minimum over its interval: members,
the smallest id, leaves (conversations that the next one does not go on from)
and saved words (the words shared with the conversation before, beyond those
above the node).  Depths between two explicit nodes are put in at the end, from
the turns of the interval's first conversation; each belongs to one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.llm.common import bound_batches, cut

#: Bytes of a turn in a sorting key (half of a SHA-256).
TURN = 16
#: Conversations in a block at least, and blocks at most: both sides of the square root.
LEAST_BLOCK, MOST_BLOCKS = 512, 65_536

SORTED = "pid int, i long, conv_id long, len long, lcp long, before long, words array<long>, edge binary"
ASKED = "block long, kind int, v long, pos long, pw long, lc long, m long, src long"
FOUND = "kind int, l long, d long, q long, m long, pw long, lc long, k long, e long, sha string, ids string, block long"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
LEFT, RIGHT, ASK_LEFT, ASK_RIGHT = range(4)
NODE, START, CHUNK = range(3)
NOTHING = 2**63 - 1


def conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and its turns in order: (turn, role, fp, words).

    Null turns come first; rows of one turn are ordered by role and by the
    text's digest, and equal rows stay as often as they are there.  Null roles
    and texts are empty ones.  Rows without a conv_id belong to no conversation.
    A conversation is one row, of some 70 bytes a turn; its texts do not move.
    """
    rows = df.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    # the role's length in front tells where it ends
    mark = F.substring(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256), 1, 2 * TURN)
    return rows.select("conv_id", F.struct("turn", "role", mark.alias("fp"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).alias("t"))


def rebuilt(df: DataFrame, family: int = 20, shared: int = 4, **names) -> DataFrame:
    """conv_id, key and words of every conversation, its first turns replaced by those of its family's first.

    Of conversation c the first h = crc32(c) % ``shared`` turns come from
    c - c % ``family`` (all if it has fewer, none if there is none), the others
    are its own.  key is the turns' digests in a row, words their counts of words.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    # one exchange, by family, serves the grouping and the look at the family's first
    per = conversations(df, **names).withColumn("base", base).repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    first = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, shared - 1)), ignorenulls=True).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string")) % shared).cast("int")
    none = F.slice("turns", 1, 0)
    per = per.withColumn("head", F.coalesce(first, none)).withColumn("h", h)
    turns = F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    return per.select("conv_id", turns.alias("turns")).select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["fp"]), "")).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))


def _shared(x: bytes, y: bytes) -> int:
    """Turns that two keys have in common."""
    import numpy as np

    most = min(len(x), len(y))
    if x[:most] == y[:most]:
        return most // TURN
    if most <= 16 * TURN:
        return next(k for k in range(most // TURN) if x[TURN * k : TURN * (k + 1)] != y[TURN * k : TURN * (k + 1)])
    return int(np.argmax(np.frombuffer(x, "u1", most) != np.frombuffer(y, "u1", most))) // TURN


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's common turns with the row before; the partition's first and last keys go along."""
    from pyspark import TaskContext

    pid, schema = TaskContext.get().partitionId(), pa.schema([("pid", pa.int32()), ("i", pa.int64()), ("conv_id", pa.int64()), ("len", pa.int64()), ("lcp", pa.int64()), ("before", pa.int64()), ("words", pa.list_(pa.int64())), ("edge", pa.binary())])
    at, last = 0, None
    for batch in batches:
        lens, lcps, befores, edges = [], [], [], []
        for key in batch.column("key").to_pylist():
            lens.append(len(key) // TURN)
            lcps.append(None if last is None else _shared(last, key))
            befores.append(None if last is None else len(last) // TURN)
            edges.append(key if last is None else None)
            last = key
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([pid] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), batch.column("conv_id"), pa.array(lens, pa.int64()), pa.array(lcps, pa.int64()), pa.array(befores, pa.int64()), batch.column("words").cast(pa.list_(pa.int64())), pa.array(edges, pa.binary())], schema=schema)
        at += n
    if last is not None:
        yield pa.RecordBatch.from_pylist([{"pid": pid, "i": -1, "len": len(last) // TURN, "edge": last}], schema=schema)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions' first rows against the last of the partition before: (pid, lcp, before)."""
    last = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["i"] == 0:
                out.append((row["pid"], -1 if last is None else _shared(last, row["edge"]), None if last is None else len(last) // TURN))
            else:
                last = row["edge"]
        pids, lcps, befores = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), pa.array(lcps, pa.int64()), pa.array(befores, pa.int64())], ["pid", "first_lcp", "first_before"])


def ranked(rows: DataFrame) -> DataFrame | None:
    """s (place in the order of keys), conv_id, len, lcp, before, wc (words of the lcp shared turns), words; None for no rows.

    lcp is -1 for the first.  ``rows`` is (conv_id, key, words); ties of keys go
    by conv_id, so equal conversations, however many, are spread over tasks.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = rows.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").select("conv_id", "key", "words")
    placed = cut(order.mapInArrow(_neighbours, SORTED), "trie-sorted")
    # as many rows as there are partitions
    counts = {r["pid"]: r["n"] for r in placed.where("i >= 0").groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    edges = placed.where("edge IS NOT NULL").select("pid", "i", "edge").coalesce(1).sortWithinPartitions("pid", F.desc("i")).mapInArrow(_edges, "pid int, first_lcp long, first_before long").collect()
    starts, total = [], 0
    for pid, lcp, before in sorted(tuple(e) for e in edges):
        starts.append((pid, total, lcp, before))
        total += counts[pid]
    small = spark.createDataFrame(starts, "pid int, start long, first_lcp long, first_before long").coalesce(1)
    rows = placed.where("i >= 0").join(F.broadcast(small), "pid")
    rows = rows.select((F.col("start") + F.col("i")).alias("s"), "conv_id", "len", F.coalesce("lcp", "first_lcp").alias("lcp"), F.coalesce("before", "first_before").alias("before"), "words")
    return rows.withColumn("wc", F.expr("aggregate(slice(words, 1, greatest(cast(lcp AS int), 0)), 0L, (a, x) -> a + x)"))


class Blocks:
    """What every task knows of every block: a few numbers each, MOST_BLOCKS blocks at most."""

    def __init__(self, rows: list, total: int, size: int):
        import numpy as np

        rows = sorted(rows, key=lambda r: r["block"])
        col = lambda name: np.array([r[name] for r in rows], "i8")
        self.n, self.size = total, size
        self.least, self.first, self.m = col("least"), col("first"), col("m")
        self.words, self.leaves = (np.concatenate([[0], np.cumsum(col(x))]) for x in ("words", "leaves"))


class Block:
    """The arrays of one block, and what follows from them alone."""

    def __init__(self, table: pa.Table, blocks: Blocks):
        import numpy as np

        table = table.sort_by("s")
        self.s, self.c, self.len, self.L, self.wc, before = (table.column(x).to_numpy() for x in ("s", "conv_id", "len", "lcp", "wc", "before"))
        self.b = int(self.s[0]) // blocks.size
        self.start, self.stop = int(self.s[0]), int(self.s[-1]) + 1
        self.leaf = self.L < np.nan_to_num(before, nan=-1)
        self.pw = blocks.words[self.b] + np.cumsum(self.wc)
        self.lc = blocks.leaves[self.b] + np.cumsum(self.leaf)
        self.m_left, self.m_right = np.minimum.accumulate(self.c), np.minimum.accumulate(self.c[::-1])[::-1]

    def smaller(self) -> tuple[list[int], list[int]]:
        """Index of the nearest smaller value on either side, in the block; -1 and the block's size where there is none."""
        L = self.L.tolist()
        left, right, stack = [-1] * len(L), [len(L)] * len(L), []
        for k, v in enumerate(L):
            while stack and L[stack[-1]] > v:
                right[stack.pop()] = k
            left[k] = left[stack[-1]] if stack and L[stack[-1]] == v else stack[-1] if stack else -1
            stack.append(k)
        return left, right


def _asking(blocks: Blocks):
    """A block's staircases of minima, and its questions."""

    def ask(table: pa.Table) -> pa.Table:
        import numpy as np

        own = Block(table, blocks)
        out: list[tuple] = []
        low = NOTHING
        for k in range(len(own.L) - 1, -1, -1):
            if own.L[k] < low:
                low = own.L[k]
                out.append((own.b, LEFT, low, own.s[k], own.pw[k], own.lc[k], own.m_right[k], None))
        low = NOTHING
        for k in range(len(own.L)):
            if own.L[k] < low:
                low = own.L[k]
                out.append((own.b, RIGHT, low, own.s[k], own.pw[k] - own.wc[k], own.lc[k], own.m_left[k - 1] if k else NOTHING, None))
        left, right = own.smaller()
        for v in {int(own.L[k]) for k in range(len(left)) if left[k] < 0 <= own.L[k]}:
            out.append((int(np.flatnonzero(blocks.least[: own.b] < v)[-1]), ASK_LEFT, v, None, None, None, None, own.b))
        for v in {int(own.L[k]) for k in range(len(right)) if right[k] == len(right) and own.L[k] >= 0}:
            later = np.flatnonzero(blocks.least[own.b + 1 :] < v)
            if len(later):
                out.append((own.b + 1 + int(later[0]), ASK_RIGHT, v, None, None, None, None, own.b))
        return _table(out, ASKED)

    return ask


def _table(rows: list[tuple], spec: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.split() for f in spec.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    whole = lambda c, kind: [x if x is None else int(x) for x in c] if kind != "string" else c
    return pa.table({name: pa.array(whole(c, kind), kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def _answer(table: pa.Table) -> pa.Table:
    """Answers of one block: for each question the stair it ends at; block and src change places."""
    from bisect import bisect_left

    rows = table.to_pylist()
    out = []
    for stairs, ask, sign in ((LEFT, ASK_LEFT, 1), (RIGHT, ASK_RIGHT, -1)):
        steps = sorted((r for r in rows if r["kind"] == stairs), key=lambda r: r["v"])  # values rise towards the asker
        values = [r["v"] for r in steps]
        for r in rows:
            if r["kind"] == ask:
                step = steps[bisect_left(values, r["v"]) - 1]
                out.append((r["src"], ask, r["v"], step["pos"], step["pw"], step["lc"], step["m"], r["block"]))
    return _table(out, ASKED)


def _least(c, a: int, b: int, tables: list) -> int:
    """min(c[a:b]) by a sparse table, which is made when it is first asked for."""
    import numpy as np

    if not tables:
        tables.append(c)
        step = 1
        while 2 * step <= len(c):
            tables.append(np.minimum(tables[-1][:-step], tables[-1][step:]))
            step *= 2
    k = (b - a).bit_length() - 1
    return int(min(tables[k][a], tables[k][b - (1 << k)]))


def _spanning(blocks: Blocks):
    """Every node that a block's rows belong to, with its interval; equal values fall together under (l, d)."""

    def span(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = Block(table, blocks)
        n, size = blocks.n, len(own.L)
        told = {(r["kind"], r["v"]): r for r in answers.to_pylist()}
        left, right = own.smaller()
        tables: list = []
        L, lens, ids = own.L.tolist(), own.len.tolist(), own.c.tolist()
        nodes: dict[tuple, list] = {}
        out: list[tuple] = []

        def between(a: int, b: int) -> int:
            return int(blocks.m[a:b].min()) if a < b else NOTHING

        def node(k: int) -> tuple:
            """(l, d) of the node of row k."""
            v = L[k]
            far = told[ASK_LEFT, v] if left[k] < 0 else None
            at = (far["pos"] if far else own.start + left[k], v)
            if nodes.get(at, (None,))[0] is None:
                off = told.get((ASK_RIGHT, v)) if right[k] == size else None
                if right[k] < size:
                    q, pw, lc = own.start + right[k], own.pw[right[k]] - own.wc[right[k]], own.lc[right[k]]
                elif off:
                    q, pw, lc = off["pos"], off["pw"], off["lc"]
                else:
                    q, pw, lc = n, blocks.words[-1], blocks.leaves[-1] + 1
                m = _least(own.c, 0 if far else left[k], min(right[k], size), tables)
                if far:
                    m = min(m, far["m"], between(far["src"] + 1, own.b))
                if off:
                    m = min(m, off["m"], between(own.b + 1, off["src"]))
                elif right[k] == size:
                    m = min(m, between(own.b + 1, len(blocks.m)))
                nodes[at] = [q, m, pw, lc, *nodes.get(at, (0, 0, 0, 0, 0, 0, None))[4:]]
            return at

        if own.b == 0:
            nodes[0, 0] = [n, int(blocks.m.min()), blocks.words[-1], blocks.leaves[-1] + 1, 0, 0, None]
        run: list[int] = []
        for k in range(size):
            s, d = own.start + k, lens[k]
            after = L[k + 1] if k + 1 < size else int(blocks.first[own.b + 1]) if own.b + 1 < len(blocks.first) else -1
            at = None
            if L[k] >= 0:
                at = node(k)
                nodes[at][4] += 1
            if d > L[k]:
                out.append((START, s, L[k], None, nodes[at][1] if at else None, own.pw[k], own.lc[k], 0, 0, None, None, own.b))
            if d > max(L[k], after):
                nodes[s, d] = [s + 1, ids[k], own.pw[k], own.lc[k] + 1, 0, 1, hashlib.sha256(str(ids[k]).encode()).hexdigest()]
                continue
            # it ends where others go on, or has copies: a run of copies is hashed here if all of it is here
            end = at if L[k] == d else (s, d)
            run.append(ids[k])
            if k + 1 < size and after == d and lens[k + 1] == d:
                continue
            whole = L[k - len(run) + 1] < d and not (k + 1 == size and after == d)
            text = ",".join(map(str, run))
            if end in nodes:
                nodes[end][5] += len(run)
                if whole:
                    nodes[end][6] = hashlib.sha256(text.encode()).hexdigest()
            elif whole or k + 1 < size:
                nodes[end] = [None, None, None, None, 0, len(run), hashlib.sha256(text.encode()).hexdigest() if whole else None]
            else:
                out.append((NODE, *end, None, None, None, None, 0, len(run), None, None, own.b))
            if not whole:
                out.append((CHUNK, *end, None, None, None, None, 0, 0, None, text, own.b))
            run = []
        for (l, d), (q, m, pw, lc, k, e, sha) in nodes.items():
            out.append((NODE, l, d, q, m, pw, lc, k, e, sha, None, own.b))
        return _table(out, FOUND)

    return span


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of ids that come in several pieces, sorted; one piece is held at a time."""
    now, state = None, None
    row = lambda: pa.RecordBatch.from_pylist([{"l": now[0], "d": now[1], "sha": state.hexdigest()}], schema=pa.schema([("l", pa.int64()), ("d", pa.int64()), ("sha", pa.string())]))
    for batch in batches:
        for l, d, ids in zip(batch.column("l").to_pylist(), batch.column("d").to_pylist(), batch.column("ids"), strict=True):
            if (l, d) != now:
                if now:
                    yield row()
                now, state = (l, d), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
    if now:
        yield row()


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes whose interval begins with one conversation: its depths beyond those it shares with the one before."""
    import numpy as np

    empty = hashlib.sha256(b"").hexdigest()
    names, kinds = zip(*[f.split() for f in NODES.split(", ")], strict=True)
    for batch in batches:
        for row in batch.to_pylist():
            found = sorted(row["nodes"], key=lambda x: x["d"])
            top, depths = max(row["lcp"] + 1, 0), [x["d"] for x in found]
            spent = np.concatenate([[0, 0], np.cumsum(np.array(row["words"] or [], "i8"))])  # words above a depth: those of the depths before it
            for lo in range(top, row["len"] + 1, 10_000):
                each = np.arange(lo, min(lo + 10_000, row["len"] + 1))
                at = np.searchsorted(depths, each).tolist()
                above = [found[k]["m"] for k in np.searchsorted(depths, each - 1).tolist()]
                out: list[list] = [[] for _ in names]
                for d, k, up in zip(each.tolist(), at, above, strict=True):
                    x = found[k]
                    inner = d < x["d"]
                    n = x["q"] - row["s"]
                    values = (x["m"], d, None if d == 0 else up if d > top else row["m"], n, 1 if inner else x["k"] + 1 - x["e"], x["lc"] - row["lc"], x["pw"] - row["pw"] - (n - 1) * int(spent[d]), empty if inner or not x["e"] else x["sha"])
                    for column, v in zip(out, values, strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if kind == "long" else pa.string()) for c, kind in zip(out, kinds, strict=True)], names)


def trie(rows: DataFrame) -> DataFrame:
    """One row a node of the trie of (conv_id, key, words); see :func:`nodes`."""
    spark = rows.sparkSession
    order = ranked(rows)
    if order is None:
        return spark.createDataFrame([], NODES)
    order = cut(order, "trie-ranked")
    total = order.agg(F.max("s")).first()[0] + 1
    size = max(LEAST_BLOCK, -(-total // MOST_BLOCKS))
    block = F.floor(F.col("s") / size).cast("long").alias("block")
    numbers = order.select(block, "s", "conv_id", "len", "lcp", "wc", F.col("before").cast("double").alias("before"))
    told = numbers.groupBy("block").agg(F.min("lcp").alias("least"), F.min_by("lcp", "s").alias("first"), F.min("conv_id").alias("m"), F.sum("wc").alias("words"), F.count_if(F.col("lcp") < F.coalesce("before", F.lit(-1.0))).alias("leaves"))
    blocks = Blocks(told.collect(), total, size)
    asked = numbers.groupBy("block").applyInArrow(_asking(blocks), ASKED)
    answers = asked.groupBy("block").applyInArrow(_answer, ASKED)
    found = numbers.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_spanning(blocks), FOUND)
    found = cut(found, "trie-nodes")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    chunks = found.where(F.col("kind") == CHUNK).select("l", "d", "block", "ids").repartition(int(parts), "l", "d").sortWithinPartitions("l", "d", "block").mapInArrow(_hashed, "l long, d long, sha string")
    whole = found.where(F.col("kind") != CHUNK).select("kind", "l", "d", "q", "m", "pw", "lc", "k", "e", "sha")
    late = chunks.select(F.lit(NODE).alias("kind"), "l", "d", *[F.lit(None).cast("long").alias(x) for x in ("q", "m", "pw", "lc")], F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("e"), "sha")
    # rows of one node are as many as the blocks it spans, and one exchange by l serves both groupings
    per = whole.unionByName(late).repartition(int(parts), "l").groupBy("l", "d", "kind").agg(*[F.max(x).alias(x) for x in ("q", "m", "pw", "lc", "sha")], F.sum("k").alias("k"), F.sum("e").alias("e"))
    is_node = F.col("kind") == NODE
    start = lambda x: F.max(F.when(~is_node, F.col(x))).alias(x)
    per = per.groupBy("l").agg(F.collect_list(F.when(is_node, F.struct("d", "q", "m", "k", "e", "sha", "pw", "lc"))).alias("nodes"), start("m"), start("pw"), start("lc"))
    own = order.where("len > lcp").select("s", "len", "lcp", "words")
    return own.join(per, F.col("s") == F.col("l")).select("s", "len", "lcp", "words", "m", "pw", "lc", "nodes").mapInArrow(_expanded, NODES)


def nodes(df: DataFrame, family: int = 20, shared: int = 4, **names) -> DataFrame:
    """The prefix trie of the rebuilt conversations of ``df``, one row a node.

    conv_id (the smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256, as long but
    for the last.  How turns are ordered and what nulls mean is said at
    :func:`conversations`; columns of other names are not read.  Conversations
    without a turn count as members of the root.  An empty table, or one
    without any conv_id, has no members and so no nodes: the result is empty.
    """
    return trie(rebuilt(df, family, shared, **names))


#: The same in SQL: prefixes as chains of digests, subtrees by the prefixes that conversations share.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || ':' || text)) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base FROM turns
), crc AS (
  SELECT conv_id, base, (SELECT list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x)::BIGINT), lambda i: ascii(substr(x, i + 1, 1))::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END))) AS r
  FROM (SELECT *, CAST(conv_id AS VARCHAR) AS x FROM convs)
), heads AS (
  SELECT conv_id, base, xor(r, 4294967295) % 4 AS h FROM crc
), kept AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM heads c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM heads c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h
), rows_ AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, sha256(length(role) || ':' || role || ':' || text) AS mark, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM kept
), lists AS (
  SELECT c.conv_id, coalesce(list(mark ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS marks, coalesce(max(d), 0) AS n FROM convs c LEFT JOIN rows_ r USING (conv_id) GROUP BY c.conv_id
), paths AS (
  SELECT conv_id, n, d, sha256(array_to_string(marks[1:d], '')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(marks[1:d - 1], '')) END AS up FROM (SELECT *, unnest(range(n + 1)) AS d FROM lists)
), per AS (
  SELECT p.node, p.d, min(p.up) AS up, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(coalesce(r.words, 0)) AS words,
    sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE p.n = p.d), '')) AS ends_sha256
  FROM paths p LEFT JOIN rows_ r ON r.conv_id = p.conv_id AND r.d = p.d GROUP BY p.node, p.d
), children AS (
  SELECT a.node, a.d, count(b.node) AS n_children FROM per a LEFT JOIN per b ON b.up = a.node AND b.d = a.d + 1 GROUP BY a.node, a.d
), below AS (
  SELECT DISTINCT a.node, a.d, b.node AS under, b.d AS under_d FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.d >= a.d
), sums AS (
  SELECT w.node, w.d, CAST(count(*) FILTER (WHERE c.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((p.n_convs - 1) * p.words) AS BIGINT) AS saved_tokens
  FROM below w JOIN per p ON p.node = w.under AND p.d = w.under_d JOIN children c ON c.node = w.under AND c.d = w.under_d GROUP BY w.node, w.d
)
SELECT p.conv_id, CAST(p.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, p.n_convs, c.n_children, s.n_leaves, s.saved_tokens, p.ends_sha256
FROM per p JOIN children c USING (node, d) JOIN sums s USING (node, d) LEFT JOIN per u ON u.node = p.up AND u.d = p.d - 1
"""

"""Jaccard join on word n-grams with a MinHash LSH forest and exact verification.

Every document gets ``TREES`` paths of ``DEPTH`` min-hash levels; a path is one
long whose leading bits are a prefix of the path, so that a tree's sorted paths
are its trie and equal leading bits are one of its nodes.  Documents that share
a node are candidates.  The prefix length starts at the full depth, where
documents of similarity 0.8 meet with probability 0.9977, and is shortened
until the links found account for the target recall: a link of similarity s is
found with probability 1 - (1 - s^k)^TREES, and the links that were found say
how many were missed.

Texts whose words are the same form one class and are handled once.  Candidates
of a node are tied if all their levels together make the similarity likely;
groups so tied are compared exactly, in blocks inside tasks, which count links
and return a spanning forest of them, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.llm.common import bits_of, cut, held, join_counted, lean, located, packed, sorted_out, without
from foliograph.llm.graph import components

WORDS_PER_SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH, LEVEL_BITS = 20, 6, 10
TARGET_RECALL = 0.999
#: Candidates are tied unless their paths agree on so many standard deviations fewer levels than texts at the threshold do.
MARGIN = 5
#: Rows of one block of a trie node, and documents of one of a candidate group; a task compares two blocks at most.
NODE_BLOCK, BLOCK = 4096, 512
CHUNK = 1 << 20
#: Rows whose texts are held as Python strings at a time.
SLICE = 512

_R = 0x9E3779B97F4A7C15


def _tables(n: int):
    """Powers of an odd base and of its inverse, modulo 2^64."""
    import numpy as np

    powers = held("near-copies")
    if "n" not in powers or powers["n"] < n:
        n = max(n, CHUNK)
        base = np.full(n + 1, _R, "u8")
        base[0] = 1
        inverse = np.full(n + 1, pow(_R, -1, 1 << 64), "u8")
        inverse[0] = 1
        powers.update(n=n, up=np.cumprod(base, dtype="u8"), down=np.cumprod(inverse, dtype="u8"))
    return powers["up"], powers["down"]


def normal(text: str | None) -> str:
    """Lower case, single spaces; null counts as empty."""
    return " ".join(text.lower().split()) if text else ""


def shingles(texts: list[str], size: int = WORDS_PER_SHINGLE):
    """64-bit hashes of the shingles of normalised, non-empty texts, and where each text's begin.

    A text of fewer words than a shingle has one, its words.
    """
    import numpy as np

    raw = " ".join(texts).encode()
    buf = np.frombuffer(raw, "u1")
    up, down = _tables(len(buf))
    total = np.zeros(len(buf) + 1, "u8")
    np.cumsum((buf.astype("u8") + np.uint64(1)) * up[: len(buf)], out=total[1:])
    gaps = np.flatnonzero(buf == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(buf)]])
    words = np.array([t.count(" ") + 1 for t in texts])
    first = np.concatenate([[0], np.cumsum(words)[:-1]])
    made = np.maximum(words - size + 1, 1)
    offsets = np.concatenate([[0], np.cumsum(made)[:-1]])
    begin = np.repeat(first - offsets, made) + np.arange(int(made.sum()))
    last = begin + np.repeat(np.minimum(words, size), made) - 1
    s, e = starts[begin], ends[last]
    h = (total[e] - total[s]) * down[s] + (e - s).astype("u8")
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h, offsets


def _paths(texts: list[str]):
    """TREES longs for each text."""
    import numpy as np

    h, offsets = shingles(texts)
    low = (h >> np.uint64(32)).astype("u4")
    rng = np.random.Generator(np.random.PCG64(20240229))
    factors = rng.integers(0, 1 << 32, TREES * DEPTH, dtype="u8").astype("u4") | np.uint32(1)
    shifts = rng.integers(0, 1 << 32, TREES * DEPTH, dtype="u8").astype("u4")
    out = np.zeros((len(texts), TREES), "i8")
    v = np.empty_like(low)
    for k in range(TREES * DEPTH):
        np.multiply(low, factors[k], out=v)
        np.add(v, shifts[k], out=v)
        v ^= v >> np.uint32(15)
        least = np.minimum.reduceat(v, offsets)
        level = ((least * np.uint32(0x85EBCA6B)) >> np.uint32(32 - LEVEL_BITS)).astype("i8")
        tree = k // DEPTH
        out[:, tree] = (out[:, tree] << LEVEL_BITS) | level
    return out


def _chunks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Places and normalised texts of non-empty texts, about CHUNK characters at a time."""
    places, found, n = [], [], 0
    for k, t in enumerate(texts):
        t = normal(t)
        if not t:
            continue
        if n and n + len(t) > CHUNK:
            yield places, found
            places, found, n = [], [], 0
        places.append(k)
        found.append(t)
        n += len(t)
    if places:
        yield places, found


SIGNED = "row_id long, place string, copy long, proof long, paths array<long>"


def _signed(bits: int):
    """Row, two halves of the digest of its words (the first one cut to ``bits``), and its paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        keep = (1 << bits) - 1
        for b in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            texts = b.column("text").to_pylist()
            copy, proof, paths = [None] * len(texts), [None] * len(texts), [None] * len(texts)
            for places, found in _chunks(texts):
                rows = _paths(found)
                for k, t, row in zip(places, found, rows, strict=True):
                    d = xxhash.xxh3_128_digest(t.encode())
                    first = int.from_bytes(d[:8], "little") & keep
                    copy[k], proof[k] = first - (1 << 64) * (first >> 63), int.from_bytes(d[8:], "little", signed=True)
                    paths[k] = row
            yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("place"), pa.array(copy, pa.int64()), pa.array(proof, pa.int64()), pa.array(paths, pa.list_(pa.int64()))], ["row_id", "place", "copy", "proof", "paths"])

    return run


def _alike(least: int):
    """Ties candidates of one trie node whose paths agree on ``least`` levels; rows come sorted by node and block pair.

    Every row not yet tied is compared with those that are, so a group of near
    copies costs one comparison a row; what comes out is a forest, never pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        key, copies, paths, out = None, [], [], []

        def flush() -> None:
            a = np.array(paths, "i8")
            levels = np.concatenate([(a >> (LEVEL_BITS * d)) & ((1 << LEVEL_BITS) - 1) for d in range(DEPTH)], axis=1).astype("u2")
            left = np.arange(len(a))
            while len(left):
                todo, left = [left[0]], left[1:]
                while todo and len(left):
                    u = todo.pop()
                    near = (levels[left] == levels[u]).sum(1) >= least
                    for v in left[near].tolist():
                        out.append((copies[u], copies[v]))
                        todo.append(v)
                    left = left[~near]

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("node", "i", "j", "copy", "paths")), strict=True):
                if row[:3] != key:
                    if len(copies) > 1:
                        flush()
                        if len(out) > 50_000:
                            yield packed()
                            out = []
                    key, copies, paths = row[:3], [], []
                copies.append(row[3])
                paths.append(row[4])
        if len(copies) > 1:
            flush()
        yield packed()

    return run


def expected_recall(s: float, depth: int, trees: int = TREES) -> float:
    """The chance that texts of similarity ``s`` share a trie node of this depth."""
    return 1 - (1 - s**depth) ** trees


def _compared(threshold: float, depth: int, trees: int):
    """Compares the blocks of candidate groups; rows come sorted by group and block pair."""

    def flush(rows: list[tuple]) -> Iterator[tuple]:
        import numpy as np

        texts = [r[4] for r in rows]
        weight = np.array([r[3] for r in rows], "i8")
        side = np.array([r[2] for r in rows])
        h, offsets = shingles(texts)
        bounds = np.append(offsets, len(h))
        sets = [np.unique(h[bounds[k] : bounds[k + 1]]) for k in range(len(rows))]
        sizes = np.array([len(x) for x in sets])
        values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(rows)), sizes)
        shared = counts > 1  # a shingle of one document is in no intersection
        rank = np.cumsum(shared) - 1
        owner, code = owner[shared[codes]], rank[codes[shared[codes]]]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        n_codes = int(shared.sum())
        left = np.flatnonzero(side == side.min())
        right = np.flatnonzero(side == side.max())
        one = side.min() == side.max()
        common = np.zeros((len(left), len(right)), "f4")
        at_left, at_right = np.full(len(rows), -1), np.full(len(rows), -1)
        at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
        for start in range(0, n_codes, 4096):
            lo, hi = np.searchsorted(code, [start, start + 4096])
            o, c = owner[lo:hi], code[lo:hi] - start
            x = np.zeros((len(left), 4096), "f4")
            in_left = at_left[o] >= 0
            x[at_left[o[in_left]], c[in_left]] = 1
            if one:
                y = x
            else:
                y = np.zeros((len(right), 4096), "f4")
                in_right = at_right[o] >= 0
                y[at_right[o[in_right]], c[in_right]] = 1
            common += x @ y.T
        union = sizes[left][:, None] + sizes[right][None, :] - common
        linked = common >= threshold * union - 1e-9 * union
        if one:
            np.fill_diagonal(linked, False)
        similarity = common[linked] / union[linked]
        counted = float((1 / (1 - (1 - similarity.astype("f8") ** depth) ** trees)).sum()) / (2 if one else 1)
        found = float(linked.sum()) / (2 if one else 1)
        links = np.zeros(len(rows), "i8")
        links[left] += linked @ weight[right]
        if not one:
            links[right] += linked.T @ weight[left]
        # spanning forest: breadth first over the rows of the matrix
        parent: list[tuple[int, int]] = []
        seen = np.zeros(len(rows), bool)
        for root in range(len(rows)):
            if seen[root]:
                continue
            seen[root] = True
            todo = [root]
            while todo:
                u = todo.pop()
                near = []
                if at_left[u] >= 0:
                    near.append(right[linked[at_left[u]] & ~seen[right]])
                if at_right[u] >= 0 and not one:
                    near.append(left[linked[:, at_right[u]] & ~seen[left]])
                for group in near:
                    for v in group.tolist():
                        if not seen[v]:
                            seen[v] = True
                            parent.append((u, v))
                            todo.append(v)
        copies = [r[1] for r in rows]
        yield (copies[0], None, 0, found, counted)
        for k in np.flatnonzero(links).tolist():
            yield (copies[k], None, int(links[k]), 0.0, 0.0)
        for u, v in parent:
            yield (copies[u], copies[v], 0, 0.0, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["copy", "other", "links", "found", "counted"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("component", "i", "j", "copy", "side", "n", "text")), strict=True):
                if row[:3] != key:
                    if len(rows) > 1:
                        out.extend(flush(rows))
                        if len(out) > 50_000:
                            yield packed()
                            out = []
                    key, rows = row[:3], []
                rows.append((None, row[3], row[4], row[5], normal(row[6])))
        if len(rows) > 1:
            out.extend(flush(rows))
        yield packed()

    return run


def join(df: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row for each row of ``df``: doc_id, class_id, copy_id, n_links, kept.

    Two documents are linked when the Jaccard similarity of their sets of
    five-word shingles (lower-cased words between white space) is at least the
    threshold; the sets hold 64-bit hashes of the shingles.  n_links counts the
    other documents a document is linked to, copies included.  class_id is the
    smallest doc_id among the documents that links connect, and exactly one row
    of a class, one of that doc_id, is kept; copy_id is the smallest doc_id
    with the same words.

    Null, empty and blank texts have no shingles: no links, and each is a class
    of its own.  A text of one to four words is linked to texts of the same
    words only.  Rows that repeat a doc_id with the same words are copies of
    each other.  A null doc_id counts as the largest.  Other columns are not
    read.  An empty table gives an empty result.
    """
    return verdicts(located(df, False, _id=F.col(doc_id).cast("long"), _text=F.col(text)), threshold, target_recall, **options).drop("place")


def verdicts(located_rows: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, trees: int = TREES, bits: int = 64, report: dict | None = None) -> DataFrame:
    """What :func:`join` returns, and the place of each row, from located rows (_id, _text).

    ``trees`` (at most TREES) and ``bits`` of the class key can be lowered to
    see prefixes shortened and keys clash; ``report`` takes the depth used and
    the recall estimated.
    """
    docs = located_rows.select(F.col("_id").alias("row_id"), F.col("_text").alias("text"), F.col("_place").alias("place"))
    signed = cut(docs.mapInArrow(lean(_signed(bits)), SIGNED), "near-signatures")
    rows = signed.count()
    # texts are told apart by both halves of their digest; where the first halves clash, both make new keys
    first, seed = F.min(F.struct(F.col("row_id").isNull().alias("nil"), "row_id", "place")), 0
    while True:
        per = signed.where("copy IS NOT NULL").groupBy("copy", "proof").agg(first.alias("least"), F.count(F.lit(1)).alias("n"), F.first("paths").alias("paths"))
        classes = cut(per.select("copy", "least.row_id", "least.place", "n", "paths"), "near-classes", rows)
        clash = classes.groupBy("copy").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("copy", F.lit(True).alias("clash"))
        if clash.isEmpty():
            break
        seed += 1
        signed = signed.join(cut(clash, "near-clashes"), "copy", "left")
        signed = cut(signed.withColumn("copy", F.when(F.col("clash"), F.xxhash64("copy", "proof", F.lit(seed))).otherwise(F.col("copy"))).drop("clash"), "near-signatures")
    depth = DEPTH
    while True:
        links, edges, recall = _linked(docs, classes, rows, threshold, depth, trees)
        if recall >= target_recall or depth == 1:
            break
        depth -= 1  # shorter prefixes: more candidates
    if report is not None:
        report.update(depth=depth, recall=recall)
    linked = components(edges.select("copy", "other").toDF("a", "b"), "near-components", rows)
    counted = links.groupBy("copy").agg(F.sum("links").alias("links"))
    per = classes.select("copy", "row_id", "place", "n").join(linked.withColumnRenamed("v", "copy"), "copy", "left").join(counted, "copy", "left")
    per = cut(per.withColumn("component", F.coalesce("component", "copy")), "near-placed", rows)
    tops = per.groupBy("component").agg(first.alias("top"), F.count(F.lit(1)).alias("m"))
    found = join_counted(per, tops, ["component"], "m", rows).select("copy", F.col("top.row_id").alias("class_id"), F.col("top.place").alias("top"), F.col("row_id").alias("copy_id"), "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    found = cut(found, "near-verdicts", rows)
    own = signed.select("row_id", "place", "copy")
    with_words = join_counted(own.where("copy IS NOT NULL"), found, ["copy"], "n", rows)
    out = with_words.select(F.col("row_id").alias("doc_id"), "class_id", "copy_id", "n_links", (F.col("place") == F.col("top")).alias("kept"), "place")
    blank = own.where("copy IS NULL").select(F.col("row_id").alias("doc_id"), F.col("row_id").alias("class_id"), F.col("row_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"), "place")
    return packed(out.unionByName(blank), rows)


def _linked(docs: DataFrame, classes: DataFrame, rows: int, threshold: float, depth: int, trees: int) -> tuple[DataFrame, DataFrame, float]:
    """Verified links of the classes that share a trie node of this depth: counts, a spanning forest, and the estimated recall.

    A node of a tree is named by a hash of the tree and the leading bits of its
    paths.  Candidates of a node are tied only where their whole paths make the
    similarity likely, so that chains of chance meetings form no group; then
    texts are compared within the groups.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    node = F.xxhash64("tree", F.shiftright("path", (DEPTH - depth) * LEVEL_BITS)).alias("node")
    used = classes.select("copy", F.slice("paths", 1, trees).alias("paths"))
    nodes = used.select("copy", "paths", F.posexplode("paths").alias("tree", "path")).select("copy", node, "paths")
    shared = cut(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-nodes", trees * rows)
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = sorted_out(nodes, bits_of(shared, "node"), "node").where("_maybe").drop("_maybe")
    met = join_counted(met, shared, ["node"], "n", total)
    met = _in_blocks(met.withColumn("blocks", F.ceil(F.col("n") / NODE_BLOCK).cast("int")))
    met = met.select("node", "pair.i", "pair.j", "copy", "paths").repartition(tasks, "node", "i", "j").sortWithinPartitions("node", "i", "j", "copy")
    levels = trees * DEPTH
    least = int(levels * threshold - MARGIN * (levels * threshold * (1 - threshold)) ** 0.5)
    members = components(met.mapInArrow(lean(_alike(least)), "a long, b long"), "near-candidates", 2 * rows)
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = join_counted(members, sizes, ["component"], "size", rows).join(classes.select(F.col("copy").alias("v"), "n", "place"), "v")
    members = _in_blocks(members.withColumnRenamed("v", "copy").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")))
    members = cut(members.select("copy", "component", "n", "place", "block", "pair"), "near-members")

    # each class is compared by the text of one of its rows
    texts = sorted_out(docs.select("place", "text"), bits_of(members, "place"), "place").where("_maybe").select("place", "text")
    dealt = members.join(texts, "place").select("component", "pair.i", "pair.j", "copy", F.col("block").alias("side"), "n", "text")
    dealt = dealt.repartition(tasks, "component", "i", "j").sortWithinPartitions("component", "i", "j", "copy")
    found = cut(dealt.mapInArrow(lean(_compared(threshold, depth, trees)), "copy long, other long, links long, found double, counted double"), "near-links")
    total, counted = found.agg(F.sum("found"), F.sum("counted")).first()
    # no link says nothing: what the depth promises at the threshold counts
    recall = total / counted if counted else expected_recall(threshold, depth, trees)
    return found.where("other IS NULL").select("copy", "links"), found.where("other IS NOT NULL").select("copy", "other"), recall


def _in_blocks(df: DataFrame) -> DataFrame:
    """A row for each pair of blocks that a row's block takes part in; ``blocks`` is the number of its group's blocks."""
    df = df.withColumn("block", F.pmod(F.xxhash64("copy"), F.col("blocks")).cast("int"))
    return df.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(F.col("block"), k).alias("i"), F.greatest(F.col("block"), k).alias("j")))))


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` that stay, exactly one of each class, with all their columns.

    Null, empty and blank texts all stay.  Rows that repeat an id stay only if
    they are the row kept; null ids are rows like others.  Columns may have any
    name.  An empty table gives an empty result.
    """
    rows = located(df, True, _id=F.col(doc_id).cast("long"), _text=F.col(text))
    gone = verdicts(rows, **options).where("NOT kept").select(F.col("place").alias("_place"))
    return without(rows, cut(gone, "near-gone"))

"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample by repeated two-means, which keeps
the lists even; a graph over the centroids, small enough for memory, is
searched best first.  A vector near a boundary is put into the lists of
several centroids; a query reads the lists whose distance is within a ratio of
its nearest one.  (After Chen et al., "SPANN: Highly-efficient Billion-scale
Approximate Nearest Neighbor Search", 2021.)

Long lists (many equal vectors, or more rows than the centroids can spread)
are split over several tasks, as are the queries of one list.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.llm.common import cut

#: Bounds of the fit: rows of the sample, and number of centroids, which grows with the table up to here
#: (1.6 million rows); beyond that lists grow, and are split over tasks.
SAMPLE_ROWS = 32_768
MOST_LISTS = 8_192
#: Rows that a list should have.
LIST_ROWS = 200
#: A list or the queries of one are split beyond this.
SPLIT_ROWS = 8_192
#: A vector goes to at most so many lists, within this ratio of its nearest centroid's distance.
COPIES, COPY_RATIO = 4, 1.15
#: The ratio within which a query reads lists is measured: so many queries are compared with all rows,
#: and it is set so that this share of their nearest vectors is within it.
TRIALS, TARGET_RECALL = 100, 0.98
NEIGHBOURS, BEAM = 16, 64
#: Lists that a query reads at least.
READ_LEAST = 6


class Graph:
    """Centroids and the links between near ones."""

    def __init__(self, centroids):
        import numpy as np

        self.c = centroids.astype("f4")
        n = len(self.c)
        self.square = (self.c**2).sum(1)
        near = np.zeros((n, 0), int)
        if n > 1:
            k = min(NEIGHBOURS, n - 1)
            parts = []
            for at in range(0, n, 1024):
                d = self.square[None, :] - 2 * self.c[at : at + 1024] @ self.c.T
                d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
                parts.append(np.argsort(d, axis=1, kind="stable")[:, :k])
            near = np.concatenate(parts)
            # a ring keeps every centroid within reach
            near = np.concatenate([near, (np.arange(n)[:, None] + [1, n - 1]) % n], axis=1)
        self.near = near
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))

    def search(self, x, beam: int = BEAM):
        """For each row the nearest centroids found and their squared distances, nearest first."""
        import numpy as np

        n, rows = len(self.c), np.arange(len(x))
        beam = min(beam, n)
        own = (x**2).sum(1)
        seen = np.zeros((len(x), n), bool)
        dist = lambda ids: own[:, None] + self.square[ids] - 2 * np.einsum("bd,bkd->bk", x, self.c[ids])
        ids = np.tile(self.entries, (len(x), 1))
        seen[:, self.entries] = True
        d, done = dist(ids), np.zeros(ids.shape, bool)
        while True:
            open_d = np.where(done, np.inf, d)
            best = open_d.argmin(1)
            active = np.isfinite(open_d[rows, best])
            if not active.any():
                break
            done[rows, best] = True
            new = self.near[ids[rows, best]]
            fresh = ~seen[rows[:, None], new] & active[:, None]
            np.logical_or.at(seen, (rows[:, None], new), fresh)
            new_d = np.where(fresh, dist(new), np.inf)
            # a centroid listed twice in one step counts once
            order = np.argsort(new, axis=1, kind="stable")
            twice = np.zeros(new.shape, bool)
            sorted_new = np.take_along_axis(new, order, 1)
            np.put_along_axis(twice, order[:, 1:], sorted_new[:, 1:] == sorted_new[:, :-1], 1)
            new_d[twice] = np.inf
            ids, d, done = np.concatenate([ids, new], 1), np.concatenate([d, new_d], 1), np.concatenate([done, ~np.isfinite(new_d)], 1)
            if ids.shape[1] > beam:
                keep = np.argsort(d, axis=1, kind="stable")[:, :beam]
                ids, d, done = (np.take_along_axis(a, keep, 1) for a in (ids, d, done))
        order = np.argsort(d, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.maximum(np.take_along_axis(d, order, 1), 0)


def fit(sample, lists: int, seed: int = 7):
    """Centroids of about equally many sample rows: the largest part is halved until there are enough, then refined."""
    import heapq

    import numpy as np

    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)  # equal vectors would only make equal centroids
    parts = [(-len(sample), 0, np.arange(len(sample)))]
    n = 1
    while len(parts) < lists and -parts[0][0] > 1:
        _, _, rows = heapq.heappop(parts)
        x = sample[rows]
        a, b = x[rng.integers(len(x))], None
        b = x[((x - a) ** 2).sum(1).argmax()]
        for _ in range(6):
            lean = ((x - a) ** 2).sum(1) - ((x - b) ** 2).sum(1)
            half = np.zeros(len(x), bool)
            half[np.argsort(lean, kind="stable")[: len(x) // 2]] = True
            a, b = x[half].mean(0), x[~half].mean(0)
        for own in (rows[half], rows[~half]):
            heapq.heappush(parts, (-len(own), n, own))
            n += 1
    centroids = np.array([sample[rows].mean(0) for _, _, rows in sorted(parts, key=lambda p: p[1])])
    for _ in range(4):
        nearest = np.concatenate([((centroids**2).sum(1)[None] - 2 * sample[k : k + 4096] @ centroids.T).argmin(1) for k in range(0, len(sample), 4096)])
        total = np.zeros_like(centroids)
        np.add.at(total, nearest, sample)
        count = np.bincount(nearest, minlength=len(centroids))
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
    return centroids


def _unit(column: pa.Array):
    """A column of vectors as rows of length 1 (float64)."""
    import numpy as np

    x = _matrix(column)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _matrix(column: pa.Array):
    """Vectors in double precision, each scaled by a power of two, which changes no cosine."""
    import numpy as np

    n = len(column)
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), "f8").reshape(n, -1) if n else np.zeros((0, 1))
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=1e-300))[1][:, None]) if n else x


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Rows whose vector can take part: vec_id, vector."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    x = lambda f: F.exists("vector", f)
    bad = x(lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(~F.coalesce(bad, F.lit(True))).where(x(lambda v: v != 0))


def _trial_rows(n: int):
    import numpy as np

    return np.random.default_rng(11).permutation(n)[:TRIALS]


def _measured(rows: DataFrame, posted: DataFrame, graph: Graph, trials, k: int) -> tuple[float, int]:
    """The ratio that reaches the target recall on some rows of the sample, against brute force, and the beam it takes."""
    import numpy as np

    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(trials)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int]]] = [[] for _ in held.value]
        for b in batches:
            ids = b.column("vec_id").to_numpy()
            for at in range(0, b.num_rows, 4096):
                s = held.value @ _unit(b.column("vector").slice(at, 4096)).T
                # the best row of each id, before the cut
                own = ids[at : at + 4096]
                order = np.argsort(own, kind="stable")
                one, first = np.unique(own[order], return_index=True)
                s = np.maximum.reduceat(s[:, order], first, axis=1)
                m = min(k + 1, s.shape[1])
                top = np.argpartition(s, -m, axis=1)[:, -m:]
                for t in range(len(s)):
                    least: dict[int, float] = {}
                    for d, i in [*best[t], *zip((-s[t, top[t]]).tolist(), one[top[t]].tolist(), strict=True)]:
                        least[i] = min(d, least.get(i, d))
                    best[t] = sorted((d, i) for i, d in least.items())[: k + 1]
        out = [(t, i, d) for t, one in enumerate(best) for d, i in one]
        yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], kind) for n, kind in ((0, pa.int32()), (1, pa.int64()), (2, pa.float64()))], ["trial", "vec_id", "d"])

    order = Window.partitionBy("trial").orderBy("d", "vec_id")
    true = rows.mapInArrow(nearest, "trial int, vec_id long, d double").groupBy("trial", "vec_id").agg(F.min("d").alias("d")).withColumn("n", F.row_number().over(order)).where(F.col("n").between(2, k + 1))  # the first is the row itself
    pairs = posted.select("list", "vec_id").join(F.broadcast(true.select("trial", "vec_id")), "vec_id").select("trial", "vec_id", "list").distinct().collect()  # TRIALS * k ids, each in the lists of its rows
    d = np.sqrt(np.maximum((trials**2).sum(1)[:, None] + graph.square[None] - 2 * trials @ graph.c.T, 0))
    least = np.maximum(d.min(1), 1e-9)
    need: dict[tuple[int, int], float] = {}
    for r in pairs:
        key = (r["trial"], r["vec_id"])
        need[key] = min(need.get(key, np.inf), float(d[r["trial"], r["list"]] / least[r["trial"]]))
    ratio = float(np.quantile(list(need.values()), TARGET_RECALL, method="higher")) + 1e-6 if need else 1.0
    read = int((d <= ratio * least[:, None]).sum(1).max())
    return ratio, max(BEAM, 2 * read)


def search(df: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding", queries: DataFrame | None = None, report: dict | None = None) -> DataFrame:
    """The k nearest found of every query: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``, or the table
    given; candidates are all rows but the query's own.  Nearness is the
    cosine of the original vectors in double precision, ties go to the smaller
    id.  Null, zero, or vectors with null or non-finite components take no
    part, neither do vectors of another length than most of the sample; rows
    that repeat an id are candidates once, with the larger score.  Queries
    with fewer than k candidates get them all.  Of query rows that repeat an
    id, the larger score of each candidate counts.  Other columns are not read,
    and an empty table gives an empty result.  ``report`` takes the number of
    lists, and of those read for a query on average.
    """
    import numpy as np

    spark = df.sparkSession
    rows = usable(df, vec_id, vector)
    asked = usable(queries, vec_id, vector) if queries is not None else rows.where(F.col("vec_id") % every == 0)
    out = "query_id long, vec_id long, score double"
    final = "query_id long, rank int, vec_id long, score double"
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS)
    sample = [r["vector"] for r in sample.select("vector").collect()]  # SAMPLE_ROWS at most
    if not sample:
        return spark.createDataFrame([], final)
    lengths = [len(v) for v in sample]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n)) if len(set(lengths)) > 1 else lengths[0]
    rows, asked = rows.where(F.size("vector") == width), asked.where(F.size("vector") == width)
    x = np.array([v for v in sample if len(v) == width], "f8")
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    x /= np.sqrt((x * x).sum(1))[:, None]
    n = rows.count()
    lists = int(max(1, min(MOST_LISTS, len(x) // 4 or 1, n // LIST_ROWS)))
    graph = spark.sparkContext.broadcast(Graph(fit(x, lists)))  # MOST_LISTS rows at most

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value
        for whole in batches:
            for b in (whole.slice(k, 2048) for k in range(0, whole.num_rows, 2048)):
                unit = _unit(b.column("vector")).astype("f4")
                ids, d = g.search(unit, 16)
                d = np.sqrt(d)
                to, at = [], []
                for r in range(len(unit)):
                    near = (d[r, :COPIES] <= COPY_RATIO * d[r, 0] + 1e-9) & np.isfinite(d[r, :COPIES])
                    to += ids[r, :COPIES][near].tolist()
                    at += [r] * int(near.sum())
                part = b.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), part.column("vec_id"), part.column("vector")], ["list", "vec_id", "vector"])

    kind = dict(rows.dtypes)["vector"]
    posted = cut(rows.mapInArrow(put, f"list int, vec_id long, vector {kind}"), "ann-lists")
    sizes = {r["list"]: r["n"] for r in posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # MOST_LISTS rows at most
    size = np.array([sizes.get(c, 0) for c in range(len(graph.value.c))])
    ratio, beam = _measured(rows, posted, graph.value, x[_trial_rows(len(x))], k)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value
        for whole in batches:
            for b in (whole.slice(i, 2048) for i in range(0, whole.num_rows, 2048)):
                ids, d = g.search(_unit(b.column("vector")).astype("f4"), beam)
                d = np.sqrt(d)
                found = np.cumsum(size[ids] * np.isfinite(d), axis=1)
                to, at = [], []
                for r in range(len(ids)):
                    enough = int(np.searchsorted(found[r], 20 * k)) + 1
                    m = max(enough, READ_LEAST, int((d[r] <= ratio * d[r, 0] + 1e-9).sum()))
                    chosen = [int(c) for c, dc in zip(ids[r, :m], d[r, :m], strict=True) if np.isfinite(dc) and size[c]]
                    to += chosen
                    at += [r] * len(chosen)
                part = b.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), part.column("vec_id"), part.column("vector")], ["list", "vec_id", "vector"])

    reads = cut(asked.mapInArrow(ask, f"list int, vec_id long, vector {kind}"), "ann-reads")
    read_sizes = {r["list"]: r["n"] for r in reads.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    if report is not None:
        report.update(lists=int((size > 0).sum()), lists_read=sum(read_sizes.values()) / max(1, asked.count()), ratio=ratio)
    # row shards and query shards of each list; a task joins one of each
    shards = spark.createDataFrame([(c, -(-m // SPLIT_ROWS), -(-read_sizes.get(c, 1) // SPLIT_ROWS)) for c, m in sizes.items()], "list int, shards int, turns int")
    dealt = lambda table, mine: table.join(F.broadcast(shards), "list").withColumn(mine[0], F.pmod(F.xxhash64("vec_id"), F.col(mine[1])).cast("int"))
    left = dealt(reads, ("turn", "turns")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    right = dealt(posted, ("shard", "shards")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    keys = ["list", "shard", "turn"]

    def compare(q: pa.Table, p: pa.Table) -> pa.Table:
        if not q.num_rows or not p.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        a, b = _matrix(q.column("vector").combine_chunks()), _matrix(p.column("vector").combine_chunks())
        qid, pid = q.column("vec_id").to_numpy(), p.column("vec_id").to_numpy()
        na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
        unit_a, unit_b = a / na[:, None], (b / nb[:, None]).T
        by_id = np.argsort(pid, kind="stable")
        first = np.unique(pid[by_id], return_index=True)[1]
        got_q, got_p, got_s = [], [], []
        for at in range(0, len(a), 256):
            rough = unit_a[at : at + 256] @ unit_b
            rough[qid[at : at + 256, None] == pid[None, :]] = -9
            # the best row of each id, before the cut
            once = np.maximum.reduceat(rough[:, by_id], first, axis=1)
            m = min(k, once.shape[1])
            floor = np.partition(once, -m, axis=1)[:, -m]
            for r in range(len(rough)):
                near = np.flatnonzero((rough[r] >= floor[r] - 1e-9) & (rough[r] > -9))
                exact = (b[near] * a[at + r]).sum(1) / (na[at + r] * nb[near])
                best = np.lexsort((pid[near], -exact))
                best = best[np.sort(np.unique(pid[near][best], return_index=True)[1])][:k]
                got_q += [qid[at + r]] * len(best)
                got_p += pid[near][best].tolist()
                got_s += exact[best].tolist()
        return pa.table({"query_id": pa.array(got_q, pa.int64()), "vec_id": pa.array(got_p, pa.int64()), "score": pa.array(got_s, pa.float64())})

    found = left.select(*keys, "vec_id", "vector").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "vector").groupBy(*keys)).applyInArrow(compare, out)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

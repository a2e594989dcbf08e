"""Mixing sources to target weights by Pareto order sampling.

Rosén, "On sampling with probability proportional to size" (1997): every
document gets a random odds value divided by its inclusion odds; the documents
with the smallest quotients form the sample.  Copies that are certain (the
whole part of the expected number) are allocated first and take no part in the
ranking.

All of it is DataFrame expressions.  No window holds a whole source: quotients
are first counted in about sqrt(n) bins a source, the bin in which the target
is reached is found from those counts, and only the rows of that bin are
ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.llm.common import BROADCAST_ROWS, bits_of, cut, join_small, sorted_out

SEED = "mix-2"
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(per: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source (key, source, source_size, n_docs) to the same with its target.

    ``share`` times all words is dealt out by weight (the weights repeat over
    the sources in code-point order, null last); a target stops at ``most``
    times its source's size and the excess goes to the others by weight.
    """
    # one row a source from here on: unpartitioned windows over this summary only
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))).cast("int") + 1)
    per = per.withColumn("weight", w).withColumn("room", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("room") / F.col("weight"), "key")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    per = (
        per.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("full", F.col("room") / F.col("weight") <= F.col("level"))
    )
    # of the sources in this order, the full ones come first: the first open one has the level of all open ones
    first_open = F.min(F.when(~F.col("full"), F.col("room") / F.col("weight"))).over(every)
    per = per.withColumn("open_level", F.max(F.when((F.col("room") / F.col("weight") == first_open) & ~F.col("full"), F.col("level"))).over(every))
    return per.select("key", "source", "source_size", "n_docs", F.when(F.col("full"), F.col("room")).otherwise(F.col("open_level") * F.col("weight")).alias("target"))


def inclusion(sizes: DataFrame, per: DataFrame) -> DataFrame:
    """``per`` with whole (copies that every document gets), rest (words still to be drawn) and scale.

    A document is drawn with probability min(1, scale * sqrt(size)), and scale
    is such that size times probability adds up to the rest: the largest
    documents become certain one size after another until the others, rescaled,
    are not.  The window runs over the distinct sizes of a source, which are at
    most about the square root of twice its words.
    """
    each = sizes.where("size > 0").groupBy("key", "size").agg(F.sum("n").alias("n")).join(F.broadcast(per) if per.count() <= BROADCAST_ROWS else per, "key")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    each = each.withColumn("bulk", F.col("size") * F.col("n")).withColumn("root", F.floor(F.col("size") * F.col("n") * F.sqrt("size")))
    each = each.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.floor(ratio) * F.col("source_size")))
    down = Window.partitionBy("key").orderBy(F.desc("size"))
    above = F.coalesce(F.sum("bulk").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum("root").over(down.rowsBetween(0, Window.unboundedFollowing))
    each = each.withColumn("scale", (F.col("rest") - above) / open_)
    fits = (F.col("scale") >= 0) & (F.col("scale") * F.sqrt("size") <= 1)
    scale = each.where(fits).groupBy("key").agg(F.max_by("scale", "size").alias("scale"))
    return per.join(scale, "key", "left").withColumn("whole", F.floor(ratio)).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.floor(ratio) * F.col("source_size")))


def _sizes(df: DataFrame, text: str, source: str, doc_id: str, **more) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"), F.md5(t).alias("mark"), *[c.alias(k) for k, c in more.items()])
    return rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))


def _drawn(rows: DataFrame, seed: str) -> DataFrame:
    """Rows (doc_id, mark, k, size, scale, rest, n_docs) with part (inclusion), q (quotient) and its bin.

    q is in (-1, 0) for certain documents, (0, 1) for those drawn and (1, 2)
    for those that can only be taken for want of others.
    """
    says = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("mark"), F.lit(":"), F.col("k").cast("string"))
    u = (F.conv(F.substring(F.md5(says), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**13))
    part = F.when((F.col("size") <= 0) | (F.col("rest") <= 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.coalesce(F.col("scale"), F.lit(1.0)) * F.sqrt("size")))
    rows = rows.withColumn("u", u).withColumn("part", part)
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("part")) / F.col("part"))
    q = F.when(F.col("part") <= 0, F.lit(1.0) + F.col("u")).when(F.col("part") >= 1, F.col("u") - 1).otherwise(odds / (odds + 1))
    return rows.withColumn("q", q).withColumn("bin", F.floor(F.col("q") * F.ceil(F.sqrt("n_docs"))).cast("long"))


def decide(df: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = SEED, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """What :func:`mix` decides: one row for each row of ``df``, and the sources with their cuts."""
    sizes = _sizes(df, text, source, doc_id).groupBy("doc_id", "source", "key", "size", "mark").agg(F.count(F.lit(1)).alias("n"))
    sizes = cut(sizes, "mix-sizes")
    per = sizes.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    per = cut(inclusion(sizes, cut(source_targets(per, weights, share, most), "mix-targets")), "mix-sources")
    units = sizes.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    docs = _drawn(join_small(units, per.drop("source"), "key"), seed)

    filled = docs.groupBy("key", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    filled = filled.withColumn("below", F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cross = filled.where((F.col("below") < F.col("rest")) & (F.col("below") + F.col("words") >= F.col("rest"))).groupBy("key").agg(F.min(F.struct("bin", "below")).alias("x")).select("key", F.col("x.bin").alias("at"), F.col("x.below").alias("below"))
    cuts = cut(per.join(cross, "key", "left"), "mix-cuts")
    docs = join_small(docs, cuts.select("key", "at", "below"), "key", "left")
    in_order = Window.partitionBy("key").orderBy("q", F.asc_nulls_first("doc_id"), "mark", "k").rowsBetween(Window.unboundedPreceding, -1)
    inside = docs.where(F.col("bin") == F.col("at")).withColumn("extra", (F.col("below") + F.coalesce(F.sum("size").over(in_order), F.lit(0)) + F.col("size") / 2 <= F.col("rest")).cast("long"))
    outside = docs.where(F.col("at").isNull() | (F.col("bin") != F.col("at"))).withColumn("extra", _outside().cast("long"))
    out = inside.unionByName(outside).withColumn("copies", F.col("whole").cast("long") + F.col("extra"))
    return out.select("doc_id", "source", "key", "size", "mark", "n", "source_size", "target", "copies", F.col("bin").eqNullSafe(F.col("at")).alias("ranked")), cuts


def _outside():
    # without a crossing the rest is 0: nothing more is taken
    return F.when(F.col("bin") < F.col("at"), 1).otherwise(0)


def mix(df: DataFrame, **options) -> DataFrame:
    """How many copies of each document the mix takes.

    Returns one row for each row of ``df``: doc_id, source, size, source_size,
    target, copies, taken.  Every document gets the whole copies that its
    source's target allows for; the rest is drawn with inclusion proportional
    to the square root of a document's size (certain where that exceeds 1).
    Documents are taken in the order of their quotients up to the target; the
    one that crosses it is taken if that brings the sum nearer.

    Null text counts as size 0, null source is a source of its own, a null
    doc_id is drawn as the empty id.  Every row has a draw of its own: of rows
    that repeat doc_id, source and text, the k-th.  Documents of size 0 come
    last in their source.  Other columns are not read.  An empty table gives an
    empty result.
    """
    return decide(df, **options)[0].select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take(df: DataFrame, seed: str = SEED, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mix itself: the rows of ``df`` with all their columns, each as often as :func:`mix` says.

    A row's copies follow from its source's cuts, its size and its draw, so
    texts stay where they are; only rows of the bins in which targets are
    reached, and rows that repeat id, source and text, are joined with their
    decisions.  Columns may have any name; nulls and empty tables as in
    :func:`mix`.
    """
    units, cuts = decide(df, seed=seed, text=text, source=source, doc_id=doc_id, **options)
    ident = F.concat_ws("|", F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n")), "mark", "key").alias("ident")
    special = units.where("ranked OR n > 1").select(ident, "n", "copies").groupBy("ident").agg(F.first("n").alias("n"), F.sum("copies").alias("copies"))
    special = cut(special, "mix-special")
    rows = _sizes(df, text, source, doc_id, _row=F.struct(*[F.col(f"`{c}`") for c in df.columns])).withColumn("k", F.lit(0).cast("long"))
    rows = _drawn(join_small(rows.drop("source"), cuts.drop("source"), "key"), seed).withColumn("plain", F.col("whole").cast("long") + _outside())
    rows = sorted_out(rows.select("_row", ident, "plain"), bits_of(special, "ident"), "ident")
    plain = rows.where("NOT _maybe").select("_row", "plain")
    # the k-th of rows that cannot be told apart takes the k-th share of their copies
    met = rows.where("_maybe").join(special, "ident", "left").withColumn("k", F.row_number().over(Window.partitionBy("ident").orderBy(F.lit(0))))
    own = F.floor(F.col("copies") / F.col("n")) + (F.col("k") <= F.col("copies") % F.col("n")).cast("long")
    joined = met.select("_row", F.when(F.col("n").isNull(), F.col("plain")).otherwise(own).cast("long").alias("plain"))
    return plain.unionByName(joined).where("plain > 0").withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("plain")))).select("_row.*")


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, size, mark, count(*) AS n
  FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS mark FROM documents) GROUP BY ALL
), per AS (
  SELECT source, CAST(sum(size * n) AS BIGINT) AS source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM sizes GROUP BY source
), ranked AS (
  SELECT *, 2.0::DOUBLE * source_size AS room, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, coalesce('s' || source, 'n')) AS k FROM per
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(room) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM ranked
), targets AS (
  SELECT source, source_size, CASE WHEN room / weight <= level THEN room
         ELSE (SELECT level FROM levels WHERE room / weight > level ORDER BY k LIMIT 1) * weight END AS target FROM levels
), wholes AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         greatest(0.0::DOUBLE, target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size) AS rest FROM targets
), hist AS (
  SELECT source, size, CAST(sum(n) AS BIGINT) AS n FROM sizes WHERE size > 0 GROUP BY source, size
), scales AS (
  SELECT source, arg_max(scale, size) AS scale FROM (
    SELECT h.source, h.size, (w.rest - coalesce(sum(h.size * h.n) OVER (PARTITION BY h.source ORDER BY h.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(CAST(floor(h.size * h.n * sqrt(h.size)) AS BIGINT)) OVER (PARTITION BY h.source ORDER BY h.size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale
    FROM hist h JOIN wholes w ON h.source IS NOT DISTINCT FROM w.source
  ) WHERE scale >= 0 AND scale * sqrt(size) <= 1 GROUP BY source
), docs AS (
  SELECT s.doc_id, s.source, s.size, s.mark, s.k, w.source_size, w.target, w.whole, w.rest, c.scale,
         (('0x' || substr(md5('mix-2:' || coalesce(CAST(s.doc_id AS VARCHAR), '') || ':' || s.mark || ':' || s.k), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT *, unnest(range(n)) AS k FROM sizes) s JOIN wholes w ON s.source IS NOT DISTINCT FROM w.source LEFT JOIN scales c ON s.source IS NOT DISTINCT FROM c.source
), odds AS (
  SELECT *, CASE WHEN size <= 0 OR rest <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, coalesce(scale, 1.0::DOUBLE) * sqrt(size)) END AS part FROM docs
), quotients AS (
  SELECT *, (u / (1 - u)) * ((1 - part) / nullif(part, 0)) AS o FROM odds
), ordered AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN part <= 0 THEN 1.0::DOUBLE + u WHEN part >= 1 THEN u - 1 ELSE o / (o + 1) END, doc_id NULLS FIRST, mark, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM quotients
)
SELECT doc_id, source, size, source_size, target, copies, size * copies AS taken FROM (
  SELECT *, CAST(whole AS BIGINT) + CASE WHEN below + size / 2.0::DOUBLE <= rest AND rest > 0 THEN 1 ELSE 0 END AS copies FROM ordered
)
"""

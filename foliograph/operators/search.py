"""Ranked full-text search: character-bigram postings and BM25.

score(q, d) = sum over t of idf(t) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * |d| / avgdl)),
idf(t) = ln(1 + (N - df + 0.5) / (df + 0.5))   (Robertson and Zaragoza, 2009).

A word of the query stands for all of its bigrams: a page matches it if it has
them all, with the smallest of their frequencies and the sum of their weights.
Words are alternatives unless marked + (must) or - (must not).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text as X
from foliograph.operators import positions
from foliograph.operators.grammar import QueryInvalid

K1, B = 1.2, 0.75
DEFAULT_LIMIT, MOST = 20, 100
EXACT_FIELDS = ("page_id", "document_id", "original_filename")


@dataclass
class Query:
    """words: (bigrams, sign) for each word; filters: field to value."""

    text: str
    words: list[tuple[list[str], str]] = field(default_factory=list)
    filters: dict[str, str] = field(default_factory=dict)

    @property
    def grams(self) -> list[str]:
        return sorted({g for grams, _ in self.words for g in grams})


def clamp(limit: int | None) -> int:
    return min(max(DEFAULT_LIMIT if limit is None else limit, 1), MOST)


def parse(text: str) -> Query:
    """Bare words, +word, -word and field:value, for searches without an index; the whole grammar is :mod:`foliograph.operators.grammar`."""
    query = Query(text.strip())
    for part in query.text.split():
        sign = part[0] if part[0] in "+-" else ""
        body = part[len(sign) :]
        name, colon, value = body.partition(":")
        if colon and name in EXACT_FIELDS and value and not sign:
            query.filters[name] = value
            continue
        if not body or re.search(r"[:\"()\[\]{}^*~]", body) or body in ("AND", "OR", "NOT"):
            raise QueryInvalid(part)
        low = body.lower()
        query.words.append(([low[k : k + 2] for k in range(len(low) - 1)], sign))
    return query


def index_documents(results: DataFrame) -> DataFrame:
    """Succeeded analyses as search documents; those without any text are left out."""
    given = X.bm25_text(F.col("given_text"), F.col("title"), F.col("summary"), F.col("visible_text"), F.col("topics"), F.col("keywords"))
    parts = [F.col("title"), F.col("summary"), F.col("visible_text"), F.col("topics"), F.col("keywords"), given, F.col("original_filename")]
    return results.where("status = 'succeeded'").where(X.is_searched(*parts)).select("page_id", "document_id", "page_number", "image_hash", "original_filename", X.combined_text(*parts).alias("body"))


def postings(docs: DataFrame, key: str = "page_id", body: str = "body") -> DataFrame:
    """(token, key, tf): a page's pairs are counted within its row, so nothing moves."""
    return positions.postings(docs, key, body, positions=False)


def tallies(docs: DataFrame, grams: list[str], key: str = "page_id", body: str = "body") -> DataFrame:
    """key, length, and the frequency of each of these pairs (tf0, tf1, ...), counted in the text; for a search without an index."""
    rows = docs.select(key, F.lower(body).alias("low"))

    def count(g: str):
        if g[0] != g[1]:  # occurrences cannot overlap: what is left when they are taken out tells their number
            return F.floor((F.octet_length("low") - F.octet_length(F.replace("low", F.lit(g), F.lit("")))) / len(g.encode()))
        return F.regexp_count("low", F.lit("(?=" + re.sub(r"([^\w\s])", r"\\\1", g) + ")"))

    return rows.select(key, F.greatest(F.length("low") - 1, F.lit(0)).cast("long").alias("length"), *[F.coalesce(count(g), F.lit(0)).cast("long").alias(f"tf{k}") for k, g in enumerate(grams)])


def lengths(docs: DataFrame, key: str = "page_id", body: str = "body") -> DataFrame:
    return docs.select(key, F.greatest(F.length(F.lower(body)) - 1, F.lit(0)).cast("long").alias("length"))


def rank(post: DataFrame, lens: DataFrame, query: Query, key: str = "page_id", mode: str = "word_and", n: int | None = None, average: float | None = None) -> DataFrame:
    """(key, score) of every match.

    Only the query's tokens are read from the postings (a pushed-down filter on
    the sorted column); they are few, so everything after is small.
    """
    if n is None or average is None:
        n, average = lens.agg(F.count(F.lit(1)), F.avg("length")).first()
    if not n or not query.words:
        return lens.select(key, F.lit(0.0).alias("score")).limit(0)
    own = post.where(F.col("token").isin(*query.grams)) if query.grams else post.limit(0)
    df = {r["token"]: r["n"] for r in own.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many rows as the query has pairs
    per = own.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "tf"))).alias("tfs")).join(lens, key)
    weight = {g: F.lit(math.log(1 + (n - d + 0.5) / (d + 0.5))) for g, d in df.items()}
    return _scored(per, query, {g: F.element_at("tfs", F.lit(g)) for g in query.grams}, weight, F.lit(float(average or 1)), key, mode)


def rank_texts(docs: DataFrame, query: Query, key: str = "page_id", body: str = "body", mode: str = "word_and") -> DataFrame:
    """(key, score) of every match, from the texts themselves.

    The texts are read once: what is counted in them is dealt out by key, and
    that exchange of a few numbers a page serves the statistics and the scores.
    """
    grams = query.grams
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tallies(docs, grams, key, body).repartition(parts, key)
    if not query.words:
        return rows.select(key, F.lit(0.0).alias("score")).limit(0)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(grams))])
    rarity = {g: F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)) for k, g in enumerate(grams)}
    tfs = {g: F.when(F.col(f"tf{k}") > 0, F.col(f"tf{k}")) for k, g in enumerate(grams)}
    return _scored(rows.crossJoin(F.broadcast(stats)), query, tfs, rarity, F.greatest(F.col("average"), F.lit(1e-9)), key, mode)  # one row


def _scored(per: DataFrame, query: Query, tf_of: dict, weight: dict, average, key: str, mode: str) -> DataFrame:
    """Scores of rows that know their length and, by ``tf_of``, the frequency of each pair (null for none); ``weight`` has the pairs' rarity."""
    norm = K1 * (1 - B + B * F.col("length") / average)
    none = F.lit(0.0)
    scored = lambda tf, idf: idf * tf * (K1 + 1) / (tf + norm)
    total, hit, must = F.lit(0.0), F.lit(False), F.lit(True)
    for grams, sign in query.words:
        if not grams:
            if sign == "+":
                must = F.lit(False)
            continue
        distinct = list(dict.fromkeys(grams))
        tfs = [tf_of[g] for g in distinct]
        if mode == "any_bigram":
            here = F.lit(False)
            part = F.lit(0.0)
            for g, tf in zip(distinct, tfs, strict=True):
                here = here | tf.isNotNull()
                part = part + F.coalesce(scored(tf, weight.get(g, none)), none)
        else:
            here = F.lit(True)
            for tf in tfs:
                here = here & tf.isNotNull()
            low = F.least(*tfs) if len(tfs) > 1 else tfs[0]
            idf = none
            for g in grams:
                idf = idf + weight.get(g, none)
            part = F.coalesce(scored(low, idf), none)
        if sign == "-":
            must = must & ~here
            continue
        total = total + F.when(here, part).otherwise(0.0)
        hit = hit | here
        if sign == "+":
            must = must & here
    # the filter asks for the score: on the hit alone it would go below rank_texts' exchange and leave the statistics one of their own
    return per.select(key, F.when(hit & must, F.round(total, 6)).alias("score")).where("score IS NOT NULL")


def top(scores: DataFrame, limit: int | None, key: str = "page_id") -> DataFrame:
    return scores.orderBy(F.desc("score"), key).limit(clamp(limit))


def enrich(hits: DataFrame, results: DataFrame, assets: DataFrame, strict: bool = True) -> DataFrame:
    """Hits with what the ledger knows of their pages; a hit without a current analysis is an error, or left out."""
    from pyspark.sql import Window

    r = results.where("status = 'succeeded'").select("page_id", "document_id", "page_number", "original_filename", "title", "summary", "image_hash")
    # at most MOST hits, found once
    hits = hits.sparkSession.createDataFrame([tuple(x) for x in hits.limit(MOST).collect()], hits.schema)
    small = F.broadcast(hits)
    full = small.join(r.join(F.broadcast(hits.select("page_id")), "page_id").withColumn("known", F.lit(True)), "page_id", "left" if strict else "inner")
    full = full.join(assets.select("image_hash", F.col("file_path").alias("image_path")), "image_hash", "left").drop("image_hash")
    if strict:  # told when the rows are asked for, in the same join
        lost = F.raise_error(F.concat(F.lit("a hit has no current analysis: "), "page_id"))
        full = full.withColumn("page_id", F.when(F.col("known"), F.col("page_id")).otherwise(lost))
    full = full.drop("known")
    place = F.row_number().over(Window.orderBy(F.desc("score"), "page_id"))
    return full.withColumn("rank", place).withColumn("image_available", F.col("image_path").isNotNull())

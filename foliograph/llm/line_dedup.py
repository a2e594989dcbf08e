"""Line deduplication by site-relative frequency.

A line that stands on more than a given share of a host's pages is
boilerplate of that host and is dropped from its pages.  DataFrame expressions
only; SQL can say the same (:data:`ORACLE`).

The boilerplate lines of a host are few whatever its size: as each of them is
on more than ``ratio`` of the pages, there are at most 1 / ratio times as many
as an average page has lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import cut, join_small

#: A line on more than this share of a host's pages is boilerplate ...
RATIO = 0.3
#: ... if it is repeated: on one page it is no boilerplate, whatever its share (by the ratio alone,
#: every line of a host of up to three pages would go).
LEAST_PAGES = 2

HIDDEN = ("script", "style", "head", "noscript", "template")
BLOCKS = "address|article|aside|blockquote|body|br|dd|details|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
STEPS = (
    (r"(?s)<!--.*?-->", ""),
    *((rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "\n") for t in HIDDEN),
    (rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
)
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def lines_of(html):
    text = F.coalesce(html, F.lit(""))
    for pattern, by in STEPS:
        text = F.regexp_replace(text, pattern, by)
    for name, by in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(by))
    return F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(F.regexp_replace(line, r"[\x09-\x0D\x20]+", " "))), lambda line: line != "")


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def boilerplate(lines: DataFrame, ratio: float, least: int) -> DataFrame:
    """(host, lines) to one row a host: its boilerplate lines."""
    on = lines.where("host <> ''").select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    totals = cut(lines.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")), "line-hosts")
    often = join_small(on.where(F.col("pages") >= least), totals, "host").where(F.col("pages") > F.lit(ratio) * F.col("host_pages"))
    return often.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("drop"))


def deduplicate(df: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each page: page_id, host, n_lines, n_dropped, text (the lines that stay).

    Null html has no lines; pages whose url names no host have an empty host
    and keep all their lines.  Repeated rows count as pages each.  An empty
    table gives an empty result.
    """
    lines = df.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), lines_of(F.col(html)).alias("lines"))
    lines = cut(lines, "line-lines")  # read twice below
    drop = cut(boilerplate(lines, ratio, least), "line-boilerplate")
    size = F.aggregate("drop", F.lit(0), lambda a, x: a + F.octet_length(x))
    out = join_small(lines, drop, "host", "left", size=size)
    # the page's own share of its host's dropped lines comes from a hash set
    out = out.withColumn("own", F.array_intersect("lines", "drop"))
    stays = F.filter("lines", lambda line: ~F.array_contains("own", line))
    out = out.withColumn("stays", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(stays))
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("stays")).cast("long").alias("n_dropped"), F.array_join("stays", "\n").alias("text"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    text = "coalesce(html, '')"
    for pattern, by in STEPS:
        text = f"regexp_replace({text}, {_quoted(pattern)}, {'chr(10)' if by else _quoted(by)}, 'g')"
    for name, by in ENTITIES:
        text = f"replace({text}, {_quoted(name)}, {_quoted(by)})"
    return rf"""
WITH raw AS (SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(coalesce(url, ''), {_quoted(HOST)}, 1)) AS host, string_split({text}, chr(10)) AS l FROM pages),
split AS (SELECT r, page_id, host, list_filter(list_transform(l, lambda x: trim(regexp_replace(x, '[\x09-\x0D\x20]+', ' ', 'g'))), lambda x: x <> '') AS l FROM raw),
each AS (SELECT r, host, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM split),
totals AS (SELECT host, count(*) AS n FROM split GROUP BY host),
often AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT r) AS n FROM each WHERE host <> '' GROUP BY host, line) AS o JOIN totals AS t USING (host) WHERE o.n >= {LEAST_PAGES} AND o.n > {RATIO}::DOUBLE * t.n),
kept AS (SELECT e.r, string_agg(e.line, chr(10) ORDER BY e.k) AS text, count(*) AS n FROM each e LEFT JOIN often o ON e.host = o.host AND e.line = o.line WHERE o.host IS NULL GROUP BY e.r)
SELECT s.page_id, s.host, CAST(len(s.l) AS BIGINT) AS n_lines, CAST(len(s.l) - coalesce(k.n, 0) AS BIGINT) AS n_dropped, coalesce(k.text, '') AS text FROM split s LEFT JOIN kept k USING (r)
"""

"""Fill-in-the-middle: documents cut into prefix, middle and suffix and put in another order.

Escaped marker injection.  A delimiter that no unit of the text can hold is
made by escaping it; ``regexp_replace`` appends it after every unit; its number
is the number of units; ``substring_index`` takes the parts that lie before and
after a rank; removing the delimiter and undoing the escapes gives the parts
back.  All of it is one projection of built-in functions: nothing moves, and a
row needs memory for a few copies of its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The delimiter, the sign that begins an escape, and what follows it for the sign itself and for the delimiter.
DELIMITER, ESCAPE, OF_ESCAPE, OF_DELIMITER = "\x1e", "\x1b", "a", "b"
#: A unit of the escaped text: a run of letters (none begins inside an escape, which is taken whole), an escape, or any other character.
UNIT = f"[A-Za-z]+|{ESCAPE}[{OF_ESCAPE}{OF_DELIMITER}]|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + OF_ESCAPE)), F.lit(DELIMITER), F.lit(ESCAPE + OF_DELIMITER))


def unescaped(text: Column) -> Column:
    """An escape sign is always the first of two characters, so the two replacements cannot meet."""
    return F.replace(F.replace(text, F.lit(ESCAPE + OF_DELIMITER), F.lit(DELIMITER)), F.lit(ESCAPE + OF_ESCAPE), F.lit(ESCAPE))


def plain(part: Column) -> Column:
    return unescaped(F.replace(part, F.lit(DELIMITER), F.lit("")))


def _ranked(column: str, rank: str) -> Column:
    """``substring_index`` at a rank that is a column."""
    return F.expr(f"substring_index({column}, '\\u001e', {rank})")


def transform(df: DataFrame, plain_share: int = 10, spm_share: int = 20, seed: str = "1", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output and text (the input, null as empty) of every row.

    The cuts and the form follow from the id alone (sha256 of ``seed:id``), so
    reruns agree and rows that repeat an id are cut alike, each by its own
    number of units.  ``plain_share`` of 100 documents stay as they are, and so
    do empty texts and texts that hold one of the markers; ``spm_share`` of 100
    others put the suffix first.  A null id counts as the empty one; a null
    text is an empty one; other columns are not read, whatever they are named;
    an empty table gives an empty result.
    """
    own = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    marked = F.regexp_replace(escaped(F.col("text")), F.lit(UNIT), F.lit("$0" + DELIMITER))
    rows = own.select("doc_id", "text", *drawn, marked.alias("marked"))
    n = (F.length("marked") - F.length(F.replace("marked", F.lit(DELIMITER), F.lit("")))).cast("long")
    rows = rows.withColumn("n", n)
    first, second = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.withColumn("a", F.least(first, second).cast("int")).withColumn("b", F.greatest(first, second).cast("int"))
    held = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.col("text").contains(marker)
    form = F.when((F.col("text") == "") | held | (F.col("h3") % 100 >= 100 - plain_share), "plain").when(F.col("h4") % 100 < spm_share, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    cut = F.col("form") != "plain"
    # the first b units without the last delimiter; of these the last b - a are the middle; the suffix has its delimiters still
    rows = rows.withColumn("upto", F.when(cut, _ranked("marked", "b"))).withColumn("suffix", F.when(cut, plain(_ranked("marked", "cast(b - n - 1 AS int)"))))
    rows = rows.withColumn("prefix", plain(_ranked("upto", "a"))).withColumn("middle", plain(F.when(F.col("a") < F.col("b"), _ranked("upto", "a - b")).otherwise(F.when(cut, ""))))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), output.alias("output"), "text")


def restored(output: Column, form: Column) -> Column:
    """The text of an output.  No marker can overlap another or a part's end, so each is found at its first place."""
    between = lambda a, b: F.substring_index(F.substr(output, F.instr(output, a) + F.lit(len(a))), b, 1)
    rest = F.substr(output, F.instr(output, MIDDLE) + F.lit(len(MIDDLE)))
    psm = F.concat(between(PREFIX, SUFFIX), rest, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), rest, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(df: DataFrame, **options) -> DataFrame:
    """What :func:`transform` makes, with the digests of the output and of the text rebuilt from it in place of the texts."""
    made = transform(df, **options)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


#: The same in SQL: lists of units instead of delimiters.
ORACLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM units
), ranked AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM ranked
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256
FROM parts
"""

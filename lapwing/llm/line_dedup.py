"""Dropping lines that an earlier document holds, with DataFrame functions only.

Rows (hash of the key, document, position) are dealt out by range of (hash, slice of ids) and sorted inside by document
and position, so first occurrences are read off as a stream.  A slice holds at most ``SLICE`` ids, which bounds every
group however common its line is; the firsts of the slices are then compared for each key.  Only rows of numbers are
shuffled for this, and what comes back for a document is a bitmap of its dropped lines, stored sparsely: the 64-bit
words that are not zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.session import durable

# The white space that keys lose at both ends, and the letters they lower.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Ids that one slice spans, as a power of two.
SLICE_BITS = 10


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def drop_bitmaps(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 10
) -> DataFrame:
    """``id`` and ``words``, a map from word number to the 64 bits of lines 64 w ... 64 w + 63 that go.

    Only documents that lose lines have a row.  Keys are compared by two 64-bit hashes.  Keys shorter than ``least``
    code points never count.  Null and empty texts are one empty line.  Rows with the same id are one document: they
    share its smallest id, and a bitmap covers the lines of each.  Rows without an id neither take nor lose lines.
    Ids are integers.
    """
    lines = docs.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), F.posexplode(lines_of(F.col(text_column))).alias("at", "line")
    )
    keyed = lines.select("id", "at", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least)
    rows = keyed.select(
        "id", "at", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"),
        F.shiftright("id", SLICE_BITS).alias("slice"),
    )
    dealt = rows.repartitionByRange("h", "g", "slice")
    order = Window.partitionBy("h", "g", "slice").orderBy("id", "at")
    first = dealt.withColumn("first", F.first("id").over(order)).withColumn("turn", F.row_number().over(order))
    # Stored, since it is read three times: the texts are split into lines once.
    first = durable(first)
    # One row for each key and slice goes on: the smallest document of the slice.
    heads = first.where("turn = 1").select("h", "g", "slice", "first")
    leads = heads.withColumn("lead", F.first("first").over(Window.partitionBy("h", "g").orderBy("slice")))
    late = leads.where("first > lead").select("h", "g", "slice")
    # Within a slice all but the first document's lines go; in later slices those of the first go too.
    after = first.where("id > first").select("id", "at")
    firsts = first.where("id = first").join(late, ["h", "g", "slice"], "left_semi").select("id", "at")
    word = after.unionByName(firsts).groupBy("id", F.shiftright("at", 6).alias("word"))
    bits = word.agg(F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("bits"))
    return bits.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def keep_lines(docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with ``__lines``, ``__kept`` (arrays of lines); documents without a bitmap keep all."""
    marks = bitmaps.select(F.col("id").alias("__id"), F.col("words").alias("__words"))
    joined = docs.join(marks, docs[id_column].cast("long") == F.col("__id"), "left")
    split = joined.withColumn("__lines", lines_of(F.col(text_column)))
    kept = F.expr(
        "filter(__lines, (line, at) -> shiftright(coalesce(element_at(__words, shiftright(at, 6)), 0L), at % 64) & 1L = 0L)"
    )
    return split.withColumn("__kept", F.when(F.col("__words").isNull(), F.col("__lines")).otherwise(kept))


def dedup_digest(docs: DataFrame) -> DataFrame:
    """The columns of the query: doc_id, n_lines, n_dropped, kept_sha256."""
    rows = keep_lines(docs, drop_bitmaps(docs))
    return rows.select(
        "doc_id", F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("__kept", "\n"), 256).alias("kept_sha256"),
    )


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the lines dropped from its text; null texts stay null, other columns stay as they are."""
    rows = keep_lines(docs, drop_bitmaps(docs, id_column, text_column), id_column, text_column)
    text = F.when(F.col(text_column).isNotNull(), F.array_join("__kept", "\n"))
    return rows.withColumn(text_column, text).select(*docs.columns)


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
), k AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (SELECT key, min(doc_id) AS lead FROM k WHERE length(key) >= 10 GROUP BY key)
SELECT k.doc_id, count(*) AS n_lines,
  CAST(count(*) FILTER (WHERE f.lead IS NOT NULL AND k.doc_id > f.lead) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.lead IS NULL OR k.doc_id = f.lead), ''))
    AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key
GROUP BY k.doc_id
"""

"""Line dedup with DataFrame functions only.

Lines become 128-bit hashes of their keys. The hashes are range-partitioned together with the
document, so the lines of one very common key spread over as many ranges as they need, and sorted by
hash, document and position within a range; a window streams over them and marks the first
occurrence in each document. First occurrences are counted by key (partial counts before the
shuffle), and common keys go back to their lines in a join that adaptive execution can split. What
comes back to a document is no text but its keep bitmap, run-length coded: the runs (start, length)
of lines that stay. Texts are read again and cut by the bitmap.

A key is the line without white space at both ends, A-Z lower-cased; empty keys never drop a line.
Null and empty texts have one empty line. A document is a distinct pair of doc_id and text, null ids among
them: rows that repeat both count once and get the same result each, another text with the same id is another
document. An empty table gives an empty result. Other columns may have any names; one that is called n_lines or
n_dropped comes back as n_lines_before or n_dropped_before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two hashes that name a row; rows alike in id and text share them."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(doc_id, text).alias("d1"), F.xxhash64(text, F.lit(7), doc_id).alias("d2")]


def _key(line: Column) -> Column:
    return F.btrim(F.translate(line, UPPER, LOWER), F.lit(common.SPACES))


def keep_bitmaps(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_docs: int = 10) -> DataFrame:
    """(d1, d2, n_dropped, runs) of each document that loses a line; runs are the (start, len) that stay."""
    spark = docs.sparkSession
    text = F.col(text_column)
    keys = docs.select(*_row_key(F.col(id_column), text), F.posexplode(_lines(text)).alias("pos", "line"))
    keys = keys.select("d1", "d2", "pos", _key(F.col("line")).alias("key")).filter(F.col("key") != "")
    hashed = keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(11), "key").alias("h2"), "d1", "d2", "pos")
    hashed = common.written(hashed, "line-hashes")  # else the bounds of ranges were sampled by cutting all texts a second time
    ranged = hashed.repartitionByRange(max(2, common.partitions(spark)), "h1", "h2", "d1", "d2").sortWithinPartitions("h1", "h2", "d1", "d2", "pos")
    occurrences = common.written(ranged.withColumn("first", F.row_number().over(W.partitionBy("h1", "h2", "d1", "d2").orderBy("pos")) == 1), "lines")
    # Written, so that the join below deals both sides anew and adaptive execution may split a key.
    common_keys = occurrences.filter("first").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    dropped = occurrences.join(common.written(common_keys.select("h1", "h2"), "common-lines"), ["h1", "h2"])
    by_doc = dropped.groupBy("d1", "d2").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    last = F.size("gone")
    runs = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            (F.coalesce(F.get("gone", i - 1), F.lit(-1)) + 1).alias("start"),
            (F.coalesce(F.get("gone", i), F.lit(2**31 - 1)) - F.coalesce(F.get("gone", i - 1), F.lit(-1)) - 1).alias("len"),
        ),
    )
    return by_doc.select("d1", "d2", last.cast("long").alias("n_dropped"), F.filter(runs, lambda r: r["len"] > 0).alias("runs"))


def without_common_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_docs: int = 10) -> DataFrame:
    """``docs`` with ``text_column`` cut to the lines that stay, plus n_lines and n_dropped."""
    bitmaps = keep_bitmaps(docs, id_column, text_column, min_docs)
    rows = docs.select(*_row_key(F.col(id_column), F.col(text_column)), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(bitmaps, ["d1", "d2"], "left")
    # By the table's own columns, as names of the result must not be taken for them.
    row, runs, gone = rows["row"], rows["runs"], rows["n_dropped"]
    text = row[text_column]
    lines = _lines(text)
    cut = F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["start"] + 1, r["len"]))), "\n")
    cut = F.when(runs.isNull(), F.coalesce(text, F.lit(""))).otherwise(cut)
    others = [row[c].alias(c + "_before" if c in ("n_lines", "n_dropped") else c) for c in docs.columns if c != text_column]
    return rows.select(*others, cut.alias(text_column), F.size(lines).cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_common_lines(common.documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, dense_rank() OVER (ORDER BY doc_id, md5(coalesce(text, ''))) AS document, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, document, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l
), c AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT document) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY r
"""

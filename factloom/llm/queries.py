"""Queries of the text operators over the whole tables, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm import contamination, personal, statements, tokens
from factloom.session import table


# 2. duplicates hidden by formatting differences
def _classes(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "mybatis_statements")
    return statements.statement_classes(rows, F.col("id"), F.col("sql_template"), F.col("sql_normalized"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """The smallest id of each group of equal statements with each other id."""
    return _classes(spark, root).where("id <> keep_id").select("keep_id", F.col("id").alias("dup_id"))


def p2_statements(spark: SparkSession, root: str) -> DataFrame:
    """One row for each statement with its number of copies."""
    return _classes(spark, root).groupBy("keep_id").agg(F.count(F.lit(1)).alias("n_copies"))


# 6. encoding of the whole corpus
def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every text."""
    return tokens.encode_texts(table(spark, root, "documents"), F.col("doc_id"), F.col("text"))


def p6_unspaced_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every text without its white space: stretches the pattern leaves unsplit are then as long as sentences,
    and texts of two thousand characters or more are joined across tasks."""
    docs = table(spark, root, "documents").select("doc_id", F.regexp_replace("text", r"[\s\u00a0\u3000\u200b]+", "").alias("text"))
    return tokens.encode_texts(docs, F.col("doc_id"), F.col("text"), long_chars=2_048, leaf_chars=512)


# 7. test items in the corpus
def p7_passages(spark: SparkSession, root: str) -> DataFrame:
    """Passages of ten or more words that a text shares with a test item, with their place in the text."""
    docs, items = table(spark, root, "documents"), table(spark, root, "eval_items")
    return contamination.shared_passages(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Texts with the test items they hold."""
    return p7_passages(spark, root).select("doc_id", "item_id").distinct()


def p7_leaked_items(spark: SparkSession, root: str) -> DataFrame:
    """Test items with the number of texts that hold them."""
    return p7_found(spark, root).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


# 8. personal information
def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Mail addresses, phone numbers, identity numbers, street addresses and names of every text."""
    return personal.find_personal(table(spark, root, "documents"), F.col("doc_id"), F.col("text"))


def p8_redacted(spark: SparkSession, root: str) -> DataFrame:
    """Every text with its personal information replaced by typed placeholders."""
    return personal.redact_personal(table(spark, root, "documents"), F.col("doc_id"), F.col("text"))


P7_FOUND_SQL = r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w FROM eval_items WHERE text IS NOT NULL),
ds AS (SELECT doc_id, array_to_string(w[k:k + 9], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d)),
isx AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM ds JOIN isx USING (s)
"""

#: runs of matching windows along one placement of an item are one passage; offsets add up words with what stands before them
P7_PASSAGES_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\p{L}\p{N}]*[\p{L}\p{N}]+') AS parts FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, k, w, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS stop, length(w) AS len FROM (
  SELECT doc_id, k, regexp_extract(parts[k], '[\p{L}\p{N}]+$') AS w, length(parts[k]) AS n FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM d))),
ds AS (SELECT doc_id, k, array_to_string(w[k:k + 9], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k
  FROM (SELECT doc_id, list_transform(parts, lambda x: lower(regexp_extract(x, '[\p{L}\p{N}]+$'))) AS w FROM d))),
isx AS (SELECT item_id, k, array_to_string(w[k:k + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i)),
hits AS (SELECT doc_id, item_id, ds.k AS pos, ds.k - isx.k AS placed FROM ds JOIN isx USING (s)),
runs AS (SELECT doc_id, item_id, placed, min(pos) AS a, max(pos) + 9 AS b FROM (
  SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, placed ORDER BY pos) AS run FROM hits) GROUP BY doc_id, item_id, placed, run)
SELECT DISTINCT r.doc_id, r.item_id, CAST(x.stop - x.len AS INTEGER) AS start_char, CAST(y.stop AS INTEGER) AS end_char, CAST(r.b - r.a + 1 AS INTEGER) AS n_words
FROM runs r JOIN dw x ON x.doc_id = r.doc_id AND x.k = r.a JOIN dw y ON y.doc_id = r.doc_id AND y.k = r.b
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_statements, p6_ids, p6_unspaced_ids, p7_found, p7_passages, p7_leaked_items, p8_found, p8_redacted)
}
SQL: dict[str, str] = {
    "p7_found": P7_FOUND_SQL,
    "p7_passages": P7_PASSAGES_SQL,
    "p7_leaked_items": f"SELECT item_id, count(*) AS n_docs FROM ({P7_FOUND_SQL}) GROUP BY 1",
}

"""Full-text search over symbols: postings and BM25. Rows T1, T2 and L6 of the survey.

The index is a postings table (term, doc_id, tf) with document lengths. ``search`` needs none: it weighs the few terms of a
query while it reads the corpus once, and the top k is a top-n, never a global sort.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from factloom.session import cut

K1, B = 1.2, 0.75


def terms(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def class_documents(classes: DataFrame) -> DataFrame:
    """Kind, fqn, name, content of classes; content is the segments of the name."""
    return classes.select(F.lit("class").alias("kind"), "fqn", F.substring_index("fqn", "/", -1).alias("name"), F.regexp_replace("fqn", "[/$.]", " ").alias("content"))


def method_documents(methods: DataFrame) -> DataFrame:
    """methods(owner, name, desc)."""
    fqn = F.concat("owner", F.lit("#"), F.col("name"), F.col("desc"))
    return methods.select(F.lit("method").alias("kind"), fqn.alias("fqn"), "name", F.concat_ws(" ", F.regexp_replace("owner", "[/$.]", " "), "name", F.regexp_replace("desc", "[^A-Za-z0-9_]", " ")).alias("content"))


def postings(documents: DataFrame, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """term, doc_id, tf, doc_len."""
    words = documents.select(F.col(doc_id).alias("doc_id"), terms(F.col(content)).alias("w"))
    return words.select("doc_id", F.size("w").alias("doc_len"), F.explode("w").alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len"))


def _of(words: str, term: str) -> Column:
    return F.filter(words, lambda x: x == term)


def search(documents: DataFrame, query: str, limit: int, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """doc_id, score of the best ``limit`` documents; equal scores by id. A query without terms finds nothing.

    The corpus is read once: a row keeps how often it holds each term of the query, what has none goes at once, and the
    counts that weigh the terms are taken while the rest is written. Nothing but the last top-n moves.
    """
    wanted = list(dict.fromkeys(w.lower() for w in re.findall(r"[^\W_]+", query)))
    if not wanted:
        return documents.select(F.col(doc_id).alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    words = documents.select(F.col(doc_id).alias("doc_id"), terms(F.col(content)).alias("w")).select(
        "doc_id", F.size("w").alias("len"), *(F.size(_of("w", t)).alias(f"tf{k}") for k, t in enumerate(wanted))
    )
    seen = Observation()
    held = [F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(wanted))]
    counted = words.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("len").alias("total"), *held)
    hits = cut(counted.where(" OR ".join(f"tf{k} > 0" for k in range(len(wanted)))))
    n, total = seen.get["n"], seen.get["total"] or 0
    mean = total / n if total else 1.0

    def part(k: int) -> Column:
        df, tf = seen.get[f"df{k}"], F.col(f"tf{k}")
        return F.lit(math.log(1 + (n - df + 0.5) / (df + 0.5))) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(mean)))

    score = reduce(Column.__add__, map(part, range(len(wanted))))
    return hits.select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit)

"""Join against a side with unique keys, safe when a few left keys hold most rows.

Left keys with at least one in ``share`` rows (there can be no more than ``share``, whatever the input) are salted: their
rows are spread over as many tasks as a shuffle has, by a hash of the row, and the few right rows with these keys are
repeated for each salt. Nothing is broadcast, so neither side needs a bound. Rows with a null key, which match nothing,
are spread in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.session import parallelism

SHARE = 100


def heavy(left: DataFrame, key: str, share: int = SHARE, total: int | None = None, weight: str | None = None) -> list:
    """Keys with one in ``share`` rows (or of the weights), at most ``share`` of them. Counting combines before its shuffle;
    only the heavy keys themselves come to the driver. ``total`` is counted unless it is known."""
    held = left.where(F.col(key).isNotNull())
    n = F.sum(weight) if weight else F.count(F.lit(1))
    if total is None:
        total = held.agg(n).first()[0]
    if not total:
        return []
    return [r[0] for r in held.groupBy(key).agg(n.alias("_n")).where(F.col("_n") * share >= total).select(key).collect()]


def salted(left: DataFrame, key: str, hot: list) -> DataFrame:
    """``left`` with a column _salt that spreads rows with a hot key or none, and is 0 for all others."""
    others = [c for c in left.columns if c != key] or [key]
    spread: Column = F.pmod(F.xxhash64(*others), F.lit(parallelism(left.sparkSession))).cast("int")
    salt = F.when(F.col(key).isNull(), spread)
    return left.withColumn("_salt", (salt.when(F.col(key).isin(hot), spread) if hot else salt).otherwise(0))


def repeated(right: DataFrame, key: str, hot: list) -> DataFrame:
    """``right`` with each row once for every salt where its key is hot."""
    if not hot:
        return right.withColumn("_salt", F.lit(0))
    salts = F.sequence(F.lit(0), F.lit(parallelism(right.sparkSession) - 1))
    return right.withColumn("_salt", F.explode(F.when(F.col(key).isin(hot), salts).otherwise(F.array(F.lit(0)))))


def unique_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot: list | None = None, total: int | None = None) -> DataFrame:
    """``left`` with the columns of ``right`` (unique by ``key``); ``how`` is left (null where there is no match) or inner."""
    hot = heavy(left, key, total=total) if hot is None else hot
    if how == "inner" and not hot:
        return left.join(right, key)
    return salted(left, key, hot).join(repeated(right, key, hot), [key, "_salt"], how).drop("_salt")

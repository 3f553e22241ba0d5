"""References to records that don't exist, are deleted, or arrive later.

References are first aggregated by key and period, which combines before the shuffle. Keys with at least one in
``share`` of all references (at most ``share`` keys, whatever the input) are checked through a broadcast; all others
meet their targets by shuffle. Only keys that can't be cleared by their earliest reference go on to the single rows.

Defined cases: a null key is no reference; a key without a target row is ``missing``; one whose targets are all
deleted is ``deleted``; one whose earliest live target is later than the reference is ``late``; a null time is never
late and its period is null; a live target without a time precedes everything; repeated rows are reported each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.operators.skew_join import heavy
from factloom.session import cut_counted

#: live targets without a time precede everything
_ALWAYS = "1000-01-01 00:00:00"


def target_states(targets: DataFrame) -> DataFrame:
    """targets(kind, key, at, live) to kind, key, first_live (null: all deleted)."""
    at = F.coalesce("at", F.lit(_ALWAYS).cast("timestamp_ntz"))
    return targets.where(F.col("key").isNotNull()).groupBy("kind", "key").agg(F.min(F.when(F.col("live"), at)).alias("first_live"))


def dangling_references(refs: DataFrame, targets: DataFrame, share: int = 1000) -> DataFrame:
    """refs(ref_table, ref_field, kind, row_id, key, at), targets(kind, key, at, live) to ref_table, ref_field, row_id, period, cause."""
    refs = refs.where(F.col("key").isNotNull()).withColumn("id", F.concat_ws(":", "kind", "key"))
    refs = refs.withColumn("period", F.date_format("at", "yyyy-MM"))
    states = target_states(targets).select(F.concat_ws(":", "kind", "key").alias("id"), "first_live", F.lit(True).alias("found"))
    groups, counts = cut_counted(refs.groupBy("id", "period").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at")), total=F.sum("n"))
    keys = heavy(groups, "id", share, counts["total"], "n")
    rows = refs.select("ref_table", "ref_field", "row_id", "id", "at", "period")
    light_groups, light_refs, checked = groups, rows, None
    if keys:
        hot = F.broadcast(refs.sparkSession.createDataFrame([(k,) for k in keys], "id string"))
        hot_states = F.broadcast(hot.join(states.join(hot, "id", "left_semi"), "id", "left"))
        # heavy keys: every row is checked where it lies
        checked = rows.join(hot_states, "id")
        light_groups, light_refs = groups.join(hot, "id", "left_anti"), rows.join(hot, "id", "left_anti")
    # other keys: groups meet their targets by shuffle; only those not cleared go on to the rows
    light = light_groups.join(states, "id", "left")
    doubtful = light.where(F.col("found").isNull() | F.col("first_live").isNull() | (F.col("first_live") > F.col("first_at")))
    doubtful = doubtful.groupBy("id").agg(F.first("found").alias("found"), F.first("first_live").alias("first_live"))
    both = light_refs.join(doubtful, "id")
    both = both if checked is None else checked.unionByName(both)
    cause = (
        F.when(F.col("found").isNull(), "missing").when(F.col("first_live").isNull(), "deleted").when(F.col("first_live") > F.col("at"), "late")
    )
    both = both.withColumn("cause", cause)
    return both.where(F.col("cause").isNotNull()).select("ref_table", "ref_field", "row_id", "period", "cause")


def dangling_report(found: DataFrame) -> DataFrame:
    """Orphans for each table, field, period and cause."""
    return found.groupBy("ref_table", "ref_field", "period", "cause").agg(F.count(F.lit(1)).alias("n_orphans"))

"""Incremental indexing as a stream: files arrive, unchanged content is skipped, tables are merged batch by batch.

An extension of the hash skip (K18): each micro-batch is classified against the stored hashes by a join, only new and
changed rows are merged, and subscribers are told after the merge is in place. A batch that is replayed after a failure
finds its own hashes stored and changes nothing, so the sink is effectively exactly-once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators import maintain
from factloom.session import cut, scratch
from factloom.sources.store import Store
from factloom.streaming.notify import Bus

STATS = "facts://stats"


def merge_files(store: Store, batch: DataFrame, bus: Bus | None = None, changed: Callable[[DataFrame], None] | None = None) -> dict[str, int]:
    """One batch of files(artifact_id, rel_path, sha256, ...): counts of NEW, CHANGED, UNCHANGED."""
    with scratch(store.spark):
        key = ["artifact_id", "rel_path"]
        latest = maintain.merge(batch.where("false"), batch, key, stable=[])
        changes = cut(maintain.classify_changes(store.read("files"), latest, key).where("change <> 'GONE'"))
        counts = {r.change: r.n for r in changes.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most three rows
        if counts.keys() - {"UNCHANGED"}:
            fresh = cut(latest.join(changes.where("change <> 'UNCHANGED'").select(*key), key, "left_semi"))
            store.upsert("files", fresh)
            if changed is not None:
                changed(fresh)
            if bus is not None:
                bus.publish(STATS)
        return {k: counts.get(k, 0) for k in ("NEW", "CHANGED", "UNCHANGED")}


def watch_files(stream: DataFrame, store: Store, checkpoint: str, bus: Bus | None = None, changed: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Runs ``merge_files`` on each micro-batch of a stream of file rows until what is there is read."""
    return (
        stream.writeStream.foreachBatch(lambda batch, _: merge_files(store, batch, bus, changed) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def windowed_calls(calls: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Calls per kind and day from a stream with late rows; state is dropped once the watermark has passed."""
    return calls.withWatermark("at", late).groupBy(F.window("at", window).alias("period"), "call_kind").agg(F.count(F.lit(1)).alias("n_calls"))

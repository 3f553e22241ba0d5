"""Per-key results when a few keys hold most rows.

Every split of the input is reduced on its own, whatever keys it holds: keys are dictionary-encoded, the codes
counted with ``numpy.bincount`` into a dense array, and the array cut into blocks by a hash of the key. There are as many
blocks as keep one at about ``BLOCK_KEYS`` keys, by an estimate of the number of keys. Blocks of all splits meet at their
block number, sorted (Spark's sort spills), and are summed by scatter-adds into the dense accumulator of one block, which
is given out before the next begins; so memory follows the block, not the number of keys. A key that holds a third of all
rows costs each split one array slot, so no task is longer than the others. Distinct values are counted on pairs made
unique before; pairs travel whole rather than as hashes, so that counts are exact.

Defined cases: null or empty keys give no row; rows with a null ``distinct`` value count as rows only; repeated rows
count each time; an empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factloom.session import parallelism

#: keys a split keeps before it hands its arrays on; bounds a worker's memory, never the result
SPLIT_KEYS = 400_000
#: keys of a block, about
BLOCK_KEYS = 50_000

_BLOCKS = "block int, keys array<string>, n_rows array<bigint>, n_distinct array<bigint>"
_BLOCKS_ARROW = pa.schema(
    [("block", pa.int32()), ("keys", pa.list_(pa.string())), ("n_rows", pa.list_(pa.int64())), ("n_distinct", pa.list_(pa.int64()))]
)


class DenseAccumulator:
    """Dense count arrays over a growing dictionary of keys."""

    def __init__(self) -> None:
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.pending = 0
        self.merged = 0

    def add(self, keys: pa.Array, blocks: np.ndarray, rows: np.ndarray | None, distinct: np.ndarray | None) -> None:
        if not len(keys):
            return
        coded = keys.dictionary_encode()
        codes, size = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
        sums = np.zeros((2, size), np.int64)
        for k, weights in enumerate((rows, distinct)):
            if weights is None:
                continue
            if isinstance(weights, int):
                sums[k] = np.bincount(codes, minlength=size) * weights
            else:
                np.add.at(sums[k], codes, weights)
        block = np.empty(size, np.int32)
        block[codes[::-1]] = blocks[::-1]
        self.parts.append((coded.dictionary, block, sums))
        self.pending += size
        if self.pending > 2 * max(self.merged, 50_000):
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            dictionary = pa.concat_arrays([p[0] for p in self.parts]).dictionary_encode()
            codes, size = dictionary.indices.to_numpy(zero_copy_only=False), len(dictionary.dictionary)
            sums = np.zeros((2, size), np.int64)
            given = np.concatenate([p[2] for p in self.parts], axis=1)
            for k in (0, 1):
                np.add.at(sums[k], codes, given[k])
            block = np.empty(size, np.int32)
            block[codes] = np.concatenate([p[1] for p in self.parts])
            self.parts = [(dictionary.dictionary, block, sums)]
        self.merged = self.pending = len(self.parts[0][0]) if self.parts else 0

    def blocks(self) -> Iterator[pa.RecordBatch]:
        """One row for each block that holds keys; empties the accumulator."""
        self.merge()
        if not self.parts:
            return
        keys, block, sums = self.parts[0]
        order = np.argsort(block, kind="stable")
        block = block[order]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        offsets = pa.array(np.r_[starts, len(block)].astype(np.int32))
        lists = [keys.take(pa.array(order)), *(pa.array(s[order]) for s in sums)]
        self.__init__()
        whole = pa.RecordBatch.from_arrays(
            [pa.array(block[starts]), *(pa.ListArray.from_arrays(offsets, x) for x in lists)], schema=_BLOCKS_ARROW
        )
        for at in range(0, whole.num_rows, 512):
            yield whole.slice(at, 512)


def _count_split(what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = DenseAccumulator()
        for b in batches:
            acc.add(b.column("key"), b.column("block").to_numpy(), 1 if what == "rows" else None, 1 if what == "distinct" else None)
            if acc.merged > SPLIT_KEYS:
                yield from acc.blocks()
        yield from acc.blocks()

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block."""
    acc, now = DenseAccumulator(), None

    def given() -> Iterator[pa.RecordBatch]:
        for b in acc.blocks():
            yield pa.RecordBatch.from_arrays([b.column(name).flatten() for name in ("keys", "n_rows", "n_distinct")], names=["key", "n_rows", "n_distinct"])

    for b in batches:
        blocks = b.column("block").to_numpy()
        cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else []
        for start, stop in zip(cuts, np.r_[cuts[1:], len(blocks)]):
            if now is not None and blocks[start] != now:
                yield from given()
            now = blocks[start]
            part = b.slice(start, stop - start)
            keys, rows, distinct = (part.column(name).flatten() for name in ("keys", "n_rows", "n_distinct"))
            acc.add(keys, np.full(len(keys), now, np.int32), rows.to_numpy(), distinct.to_numpy())
    yield from given()


def skewed_counts(df: DataFrame, first: Column, second: Column, distinct: Column, names: tuple[str, str]) -> DataFrame:
    """Rows and distinct values of ``distinct`` for each key (first, second): names[0], names[1], n_rows, n_distinct."""
    facts = df.select(first.alias("a"), second.alias("b"), distinct.alias("d")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != "") & (F.col("b") != "")
    )
    # the length of the first part keeps the joined key unambiguous
    key = F.concat(F.length("a").cast("string"), F.lit(":"), F.col("a"), F.col("b"))
    facts = facts.select(key.alias("key"), "d")
    n_keys = facts.agg(F.approx_count_distinct("key")).first()[0]
    n_blocks = max(4 * parallelism(df.sparkSession), n_keys // BLOCK_KEYS)
    facts = facts.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int"))
    rows = facts.select("key", "block").mapInArrow(_count_split("rows"), _BLOCKS)
    # a pair of key and value lives in one task after distinct(), and heavy keys are spread over all of them
    pairs = facts.where(F.col("d").isNotNull()).distinct().select("key", "block").mapInArrow(_count_split("distinct"), _BLOCKS)
    summed = rows.unionByName(pairs).repartition("block").sortWithinPartitions("block").mapInArrow(_sum_blocks, "key string, n_rows bigint, n_distinct bigint")
    length = F.substring_index("key", ":", 1)
    start = F.length(length) + 2
    return summed.select(
        F.substr("key", start, length.cast("int")).alias(names[0]),
        F.substr("key", start + length.cast("int")).alias(names[1]),
        "n_rows",
        "n_distinct",
    )


def heavy_keys(counts: DataFrame, total: int, share: int = 100) -> DataFrame:
    """Keys with at least one in ``share`` of ``total`` rows."""
    return counts.where(F.col("n_rows") * share >= F.lit(total))

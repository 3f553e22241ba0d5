"""Token ids of whole texts by a public byte-level BPE vocabulary.

Texts are cut where the splitting pattern always splits. What the pattern leaves unsplit and is longer than a leaf (long
words, scripts without spaces) is encoded as a tree: its halves are encoded on their own, then growing windows of tokens
around the join are encoded again until the outermost token on either side is the one already there. BPE output is right
exactly if each adjacent pair of tokens is what the pair's own bytes encode to, so agreement at both ends makes the
joined list the encoding of the whole. Merging a piece costs more than in proportion to its length, so the leaves are short.

Texts of ``long_chars`` or more are cut into leaves that are encoded as rows of their own all over the cluster; leaves of
one unsplit piece are joined level by level, ``FAN`` neighbours at a time, each level spread over the cluster. Only the
finished pieces of a text meet, as they make up one row.

Null and empty texts give an empty list. Special tokens are never produced; their spelling in a text is ordinary text.
Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from factloom.session import cut_counted

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the splitting pattern published with this vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: bytes of an unsplit piece that are encoded at once, tokens around a join that are encoded first
LEAF_BYTES = 64
FIRST_WINDOW = 8
#: texts from this length on are cut into leaves of about so many characters, encoded in parallel and joined FAN at a time
LONG_CHARS = 16_384
LEAF_CHARS = 4_096
FAN = 16

_PIECE = regex.compile(PATTERN)
#: a character that is no white space before one that is: the pattern splits there, whatever else stands around
_SPLIT = regex.compile(r"(?<=\S)(?=\s)")
_SPLIT_BEFORE = regex.compile(r"(?r)(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    def __init__(self, path: str = VOCABULARY, leaf_bytes: int = LEAF_BYTES) -> None:
        self.enc = encoding(path)
        self.leaf = max(1, leaf_bytes)
        # a piece longer than a leaf has so many characters of one kind at least
        n = max(1, self.leaf // 4)
        self.dense = re.compile(rf"\S{{{n}}}|\s{{{n}}}")
        self.runs = regex.compile(rf"\p{{L}}{{{n},}}|\p{{N}}{{{n},}}|[^\s\p{{L}}\p{{N}}]{{{n},}}|\s{{{n},}}")

    def _bytes(self, tokens: list[int]) -> bytes:
        return b"".join(map(self.enc.decode_single_token_bytes, tokens))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of two adjacent stretches of one unsplit piece."""
        if not left or not right:
            return left or right
        window = FIRST_WINDOW
        while True:
            a, b = left[-window:], right[:window]
            middle = self.enc._encode_single_piece(self._bytes(a) + self._bytes(b))
            fits_left = len(a) == len(left) or middle[0] == a[0]
            fits_right = len(b) == len(right) or middle[-1] == b[-1]
            if fits_left and fits_right:
                return left[: len(left) - len(a)] + middle + right[len(b) :]
            window *= 2

    def piece(self, data: bytes) -> list[int]:
        """Encoding of one unsplit piece: leaves, then joins of neighbours, level by level."""
        if len(data) <= self.leaf:
            return self.enc._encode_single_piece(data)
        level = [self.enc._encode_single_piece(data[at : at + self.leaf]) for at in range(0, len(data), self.leaf)]
        return self.tree(level)

    def tree(self, level: list[list[int]]) -> list[int]:
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def text(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not self.dense.search(text):
            return self.enc.encode_ordinary(text)
        out: list[int] = []
        at = 0
        for run in self.runs.finditer(text):
            start, end = run.span()
            # the space before a run and what stands beside it without a space may belong to the same piece
            if start < at or len(text[start:end].encode()) + 1 <= self.leaf:
                continue
            before = _SPLIT_BEFORE.search(text, at, start + 1)
            left = before.start() if before and before.start() > at else at
            after = _SPLIT.search(text, end)
            right = after.start() if after else len(text)
            out += self.enc.encode_ordinary(text[at:left])
            for m in _PIECE.finditer(text, left, right):
                out += self.piece(m[0].encode())
            at = right
        return out + self.enc.encode_ordinary(text[at:] if at else text)


def stretches(text: str, most: int) -> Iterator[tuple[int, int, bool]]:
    """The text in stretches that begin and end where the pattern always splits: (start, end, no longer than ``most``).
    A stretch is longer only if it holds no such place."""
    start = last = 0
    for m in _SPLIT.finditer(text):
        at = m.start()
        if at - start > most:
            if last > start:
                yield start, last, last - start <= most
                start = last
            if at - start > most:
                yield start, at, False
                start = at
        last = at
    if len(text) - start > most and last > start:
        yield start, last, last - start <= most
        start = last
    if start < len(text):
        yield start, len(text), len(text) - start <= most


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_PLACE = "doc_id bigint, text_hash string, copies bigint, piece int, block int"
_PLACE_ARROW = [("doc_id", pa.int64()), ("text_hash", pa.string()), ("copies", pa.int64()), ("piece", pa.int32()), ("block", pa.int32())]
_LEAVES, _LEAVES_ARROW = f"{_PLACE}, data binary, whole boolean", pa.schema([*_PLACE_ARROW, ("data", pa.binary()), ("whole", pa.bool_())])
_DONE, _DONE_ARROW = f"{_PLACE}, whole boolean, ids array<int>", pa.schema([*_PLACE_ARROW, ("whole", pa.bool_()), ("ids", pa.list_(pa.int32()))])


def _encode(path: str, leaf_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, leaf_bytes)
        for b in batches:
            ids = [encoder.text(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], schema=_IDS)

    return run


def leaves(text: str, leaf_chars: int) -> Iterator[tuple[int, int, bytes, bool]]:
    """(piece, block, bytes, whole): stretches that split for sure are pieces of their own; unsplit pieces are cut into
    several blocks of one piece, which have to be joined."""
    piece = 0
    for start, end, whole in stretches(text, leaf_chars):
        if whole:
            yield piece, 0, text[start:end].encode(), True
            piece += 1
            continue
        for m in _PIECE.finditer(text, start, end):
            data = m[0].encode()
            for block, at in enumerate(range(0, len(data), leaf_chars)):
                yield piece, block, data[at : at + leaf_chars], False
            piece += 1


def _cut(leaf_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, key, copies, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_hash", "copies", "text"))):
                rows, size = [], 0
                for leaf in leaves(text, leaf_chars):
                    rows.append((doc, key, copies, *leaf))
                    size += len(leaf[2]) + 64
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _LEAVES_ARROW.types)], schema=_LEAVES_ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _LEAVES_ARROW.types)], schema=_LEAVES_ARROW)

    return run


def _encode_leaves(path: str, leaf_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, leaf_bytes)
        for b in batches:
            wholes = b.column("whole")
            ids = [encoder.text(data.decode()) if whole else encoder.piece(data) for data, whole in zip(b.column("data").to_pylist(), wholes.to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], wholes, pa.array(ids, pa.list_(pa.int32()))], schema=_DONE_ARROW)

    return run


def _join_neighbours(path: str, fan: int):
    def run(table: pa.Table) -> pa.Table:
        """At most ``fan`` neighbouring blocks of one piece become one."""
        encoder = Encoder(path)
        table = table.sort_by("block")
        first = table.slice(0, 1)
        ids = encoder.tree(table.column("ids").to_pylist())
        block = pa.array([first.column("block")[0].as_py() // fan], pa.int32())
        place = [first.column(c).combine_chunks() for c in ("doc_id", "text_hash", "copies", "piece")]
        return pa.Table.from_arrays([*place, block, pa.array([False]), pa.array([ids], pa.list_(pa.int32()))], schema=_DONE_ARROW)

    return run


def encode_texts(
    docs: DataFrame, doc_id: Column, text: Column, path: str = VOCABULARY, long_chars: int = LONG_CHARS, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES, fan: int = FAN
) -> DataFrame:
    """doc_id, ids: one row for each row."""
    corpus = docs.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text"))
    short = corpus.where(F.col("text").isNull() | (F.length("text") < long_chars)).mapInArrow(_encode(path, leaf_bytes), "doc_id bigint, ids array<int>")
    # rows of the same id and text are encoded once and given back as often
    long = (
        corpus.where(F.length("text") >= long_chars)
        .groupBy("doc_id", F.sha2("text", 256).alias("text_hash"))
        .agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    )
    encoded = long.mapInArrow(_cut(leaf_chars), _LEAVES).repartition("doc_id", "piece", "block").mapInArrow(_encode_leaves(path, leaf_bytes), _DONE)
    blocks, counts = cut_counted(encoded, rows=F.count(F.lit(1)), last=F.max("block"))
    if not counts["rows"]:
        return short
    pieces = blocks.where("whole")
    level, last = blocks.where("NOT whole"), counts["last"]
    while last:
        joined = level.groupBy("doc_id", "text_hash", "piece", F.floor(F.col("block") / fan)).applyInArrow(_join_neighbours(path, fan), _DONE)
        level, counts = cut_counted(joined, last=F.max("block"))
        last = counts["last"]
    whole = pieces.unionByName(level).groupBy("doc_id", "text_hash", "copies").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids")
    return short.unionByName(whole.select("doc_id", ids, F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "ids"))

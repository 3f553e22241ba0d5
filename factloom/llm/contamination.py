"""Held-out test passages inside a corpus.

Stretches of the test items form one Aho-Corasick automaton over normalised words; each text is scanned once, what is
found is extended to both sides word by word, and passages of ten words or more are mapped back to offsets of the
original text. A passage of ``window`` words always holds a stretch of window - STEP + 1 words that begins at a multiple
of STEP in its item, so only these are kept. Words are the maximal runs of letters and digits (Unicode L* and N*),
lower-cased after they are cut; whatever stands between them doesn't matter. The automaton reads word numbers rather
than characters: its size follows the test set alone.

The items are broadcast once, in blocks of at most ``BLOCK_CHARS`` characters, whose automaton takes about 40 bytes a
character; a worker builds it once and keeps it for all its tasks. Larger test sets take a scan for each block.

Defined cases: null, empty and blank texts hold nothing; items with fewer words than the window are never found; equal
items are all reported; repeated rows are reported each.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 10
STEP = 3
#: characters of test items that go into one automaton and one broadcast
BLOCK_CHARS = 8_000_000

_WORD = regex.compile(r"[\p{L}\p{N}]+")

_FOUND = "doc_id bigint, item_id bigint, start_char int, end_char int, n_words int"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("n_words", pa.int32())])


class PassageFinder:
    """Finds passages of ``window`` or more words that a text shares with items [(item_id, text)]."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW) -> None:
        self.window = window
        step = min(STEP, window)
        self.length = window - step + 1
        self.numbers: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        stretches: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, text in items:
            words = [self.numbers.setdefault(w.lower(), len(self.numbers) + 1) for w in _WORD.findall(text or "")]
            if len(words) < window:
                continue
            for at in range(0, len(words) - self.length + 1, step):
                stretches.setdefault(tuple(words[at : at + self.length]), []).append((len(self.items), at))
            self.items.append((item, words))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, places in stretches.items():
            self.automaton.add_word(key, places)
        self.empty = not stretches
        if stretches:
            self.automaton.make_automaton()

    def _hits(self, numbers: list[int]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(index of the first word, places) of each stretch; runs of unknown words can hold none and are passed over."""
        at, size = 0, len(numbers)
        while at < size:
            if not numbers[at]:
                at += 1
                continue
            end = at
            while end < size and numbers[end]:
                end += 1
            if end - at >= self.window:
                for last, places in self.automaton.iter(tuple(numbers[at:end])):
                    yield at + last - self.length + 1, places
            at = end

    def passages(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, words) of each maximal shared passage, offsets in characters of the text."""
        if not text or self.empty:
            return []
        numbers = [self.numbers.get(w.lower(), 0) for w in _WORD.findall(text)]
        found: set[tuple[int, int, int]] = set()
        reached: dict[tuple[int, int], int] = {}  # how far an item laid along the text has been followed
        for first, places in self._hits(numbers):
            for k, at in places:
                if reached.get((k, first - at), -1) > first:
                    continue
                item, words = self.items[k]
                a, p = first, at
                while a and p and numbers[a - 1] == words[p - 1]:
                    a, p = a - 1, p - 1
                b, p = first + self.length, at + self.length
                while b < len(numbers) and p < len(words) and numbers[b] == words[p]:
                    b, p = b + 1, p + 1
                reached[k, first - at] = b
                if b - a >= self.window:
                    found.add((item, a, b))
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        return sorted({(item, spans[a][0], spans[b - 1][1], b - a) for item, a, b in found})


#: the automaton a worker last built, by broadcast
_built: dict[tuple, PassageFinder] = {}


def _finder(items: Broadcast, window: int) -> PassageFinder:
    key = (items._path or id(items), window)
    if key not in _built:
        _built.clear()
        _built[key] = PassageFinder(items.value, window)
    return _built[key]


def _scan(items: Broadcast, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(items, window)
        for b in batches:
            rows = [(doc, *hit) for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")) for hit in finder.passages(text.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _FOUND_ARROW.types)], schema=_FOUND_ARROW)

    return run


def item_blocks(items: DataFrame, item_id: Column, text: Column, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str | None]]]:
    """The test items, streamed to the driver in blocks of bounded size."""
    block, size = [], 0
    for row in items.select(item_id.cast("bigint").alias("i"), text.alias("t")).where(F.col("t").isNotNull() & F.col("i").isNotNull()).toLocalIterator():
        if block and size + len(row.t) > block_chars:
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += len(row.t)
    if block:
        yield block


def shared_passages(
    docs: DataFrame, doc_id: Column, text: Column, items: DataFrame, item_id: Column, item_text: Column, window: int = WINDOW, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """doc_id, item_id, start_char, end_char, n_words of each maximal passage of ``window`` or more words."""
    corpus = docs.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text")).where(F.col("text").isNotNull())
    found = None
    for block in item_blocks(items, item_id, item_text, block_chars):
        part = corpus.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(block), window), _FOUND)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], _FOUND)

"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of 10 words of the test items, and the whole of shorter items.  Patterns
of one length are searched together: a table gives for each block of two words how far the end of
the search window may move without missing a pattern; where that is nothing, the bucket of the
block (the pattern's suffix) and of the first two words (its prefix) selects the patterns, which
are then compared word by word.  Many stretches of text are searched at the same time, one step of
the window each per array operation.

Words are compared by 64-bit hashes, ten of them for a window.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sheafwork.llm.arrays import Slices, mix, ranges, row_of, runs, text_chunks

WINDOW = 10
#: Test items are taken in blocks of this many bytes of text, each held by the workers in turn.
BLOCK_BYTES = 16 << 20
#: Positions in a stretch of text that is searched as one.
STRETCH = 96

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts laid end to end, and where each text's words start."""
    lower = _LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _IN_WORD[lower]
    start = inside[:-1].copy()
    start[1:] &= ~inside[:-2]
    first = offsets[:-1][np.diff(offsets) > 0]
    start[first] = inside[first]
    starts = np.flatnonzero(start)
    stop = inside[:-1] & ~inside[1:]
    stop[first[1:] - 1] |= inside[first[1:] - 1]
    if len(data):
        stop[-1] = inside[len(data) - 1]
    ends = np.flatnonzero(stop) + 1
    return Slices(lower).hash(starts, ends), np.searchsorted(starts, offsets)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


@dataclass
class Patterns:
    """Patterns of one number of words, ready for the search."""

    size: int
    #: One row per different pattern.
    rows: np.ndarray
    #: How far to move for a block, by the low bits of its hash.
    shift: np.ndarray
    #: Sorted bucket keys and the pattern of each entry.
    keys: np.ndarray
    entry: np.ndarray
    #: Items that hold a pattern: items[first[p]:first[p + 1]].
    first: np.ndarray
    items: np.ndarray

    @staticmethod
    def build(rows: np.ndarray, items: np.ndarray) -> Patterns:
        size = rows.shape[1]
        different, where = np.unique(rows, axis=0, return_inverse=True)
        where = where.ravel()
        pairs = np.unique(np.stack([where, items], 1), axis=0)
        first = np.searchsorted(pairs[:, 0], np.arange(len(different) + 1))
        bits = max(16, int(len(different) * size).bit_length() + 3)
        block = min(2, size)
        shift = np.full(1 << bits, size - block + 1, np.int64)
        for end in range(block, size + 1):
            key = _block(different, end - 1) & np.uint64((1 << bits) - 1)
            np.minimum.at(shift, key.astype(np.int64), size - end)
        keys = _bucket(_block(different, size - 1), _block(different, block - 1))
        order = np.argsort(keys, kind="stable")
        return Patterns(size, different, shift, keys[order], order, first, pairs[:, 1])

    def find(self, word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, pattern) of every occurrence inside the texts given by ``bounds``."""
        count = np.maximum(0, np.diff(bounds) - self.size + 1)
        stretches = -(-count // STRETCH)
        text = np.repeat(np.arange(len(count)), stretches)
        nth = ranges(np.zeros(len(count), np.int64), stretches)
        at = bounds[text] + self.size - 1 + nth * STRETCH
        stop = np.minimum(at + STRETCH, bounds[text + 1])
        mask = np.uint64(len(self.shift) - 1)
        found_at, found = [], []
        while len(at):
            block = self._block_at(word, at)
            move = self.shift[(block & mask).astype(np.int64)]
            hit = move == 0
            if hit.any():
                position, pattern = self._compare(word, at[hit], block[hit])
                found_at.append(position)
                found.append(pattern)
            at = at + np.maximum(move, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_at), np.concatenate(found)

    def _block_at(self, word: np.ndarray, end: np.ndarray) -> np.ndarray:
        return word[end] if self.size == 1 else _pair(word[end - 1], word[end])

    def _compare(self, word: np.ndarray, at: np.ndarray, block: np.ndarray):
        prefix_end = at - self.size + min(2, self.size)
        key = _bucket(block, self._block_at(word, prefix_end))
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        size = high - low
        pattern = self.entry[ranges(low, size)]
        position = np.repeat(at, size)
        same = np.ones(len(position), bool)
        for k in range(self.size):
            same &= word[position - self.size + 1 + k] == self.rows[pattern, k]
        return position[same], pattern[same]


def _block(rows: np.ndarray, end: int) -> np.ndarray:
    return rows[:, end] if rows.shape[1] == 1 else _pair(rows[:, end - 1], rows[:, end])


def _bucket(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    return _pair(suffix, prefix ^ np.uint64(0xA5A5A5A5A5A5A5A5))


@dataclass
class TestItems:
    """A block of test items: their names, and their patterns by number of words."""

    names: list[str]
    patterns: list[Patterns]

    @staticmethod
    def build(items: list[tuple[str, str | None]], window: int = WINDOW) -> TestItems:
        names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(names)}
        by_size: dict[int, tuple[list, list]] = {}
        for name, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            word, _ = words(raw, np.array([0, len(raw)]))
            if len(word):
                size = min(window, len(word))
                rows, owners = by_size.setdefault(size, ([], []))
                cut = np.lib.stride_tricks.sliding_window_view(word, size)
                rows.append(cut)
                owners.append(np.full(len(cut), number[name]))
        patterns = [
            Patterns.build(np.concatenate(rows), np.concatenate(owners))
            for _, (rows, owners) in sorted(by_size.items())
        ]
        return TestItems(names, patterns)


def item_blocks(benchmark: DataFrame, item_column: str, text_column: str, limit: int):
    """Test items in blocks of about ``limit`` bytes of text, read one block at a time."""
    block, size = [], 0
    source = benchmark.where(F.col(item_column).isNotNull()).select(
        F.col(item_column).cast("string"), F.col(text_column)
    )
    for name, text in source.toLocalIterator():
        block.append((name, text))
        size += len(text or "")
        if size >= limit:
            yield TestItems.build(block)
            block, size = [], 0
    if block:
        yield TestItems.build(block)


RESULT = (
    "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
    "contaminated boolean, items array<string>, spans binary"
)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: words, words hit, and the items found.

    ``items`` lists the items found, by name; ``spans`` the hit words as pairs of 64-bit numbers
    (first, last + 1).  A null or empty text has no words; items without words or without a name
    are never found.  Without test items nothing is hit.  A benchmark of several blocks is searched
    block after block, each worker holding one block's tables per step; what was found goes along.
    """
    source = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        F.col(text_column).alias("text"),
        F.lit(None).cast("array<string>").alias("items"),
        F.lit(None).cast("binary").alias("spans"),
    )
    context = docs.sparkSession.sparkContext
    before = None
    for block in item_blocks(benchmark, item_column, item_text, block_bytes):
        if before is not None:
            source = source.mapInArrow(_searcher(before, False), source.schema)
        before = context.broadcast(block)
    before = before or context.broadcast(TestItems([], []))
    return source.mapInArrow(_searcher(before, True), RESULT)


def _searcher(spread, last: bool):
    def search(batches):
        block = spread.value
        names = np.array(block.names, dtype=object)
        for batch in batches:
            earlier_items = batch.column("items").to_pylist()
            earlier_spans = batch.column("spans").to_pylist()
            for low, high, data, offsets in text_chunks(batch.column("text")):
                word, bounds = words(data, offsets)
                edges = np.zeros(len(word) + 1, np.int64)
                pairs = [np.empty((0, 2), np.int64)]
                for patterns in block.patterns:
                    at, pattern = patterns.find(word, bounds)
                    np.add.at(edges, at - patterns.size + 1, 1)
                    np.add.at(edges, at + 1, -1)
                    held = patterns.first[pattern + 1] - patterns.first[pattern]
                    item = patterns.items[ranges(patterns.first[pattern], held)]
                    text = np.repeat(row_of(bounds, at), held)
                    pairs.append(np.unique(np.stack([text, item], 1), axis=0))
                found = np.unique(np.concatenate(pairs), axis=0)
                items: list[list[str]] = [list(e or ()) for e in earlier_items[low:high]]
                for text, item in found.tolist():
                    items[text].append(names[item])
                for text, raw in enumerate(earlier_spans[low:high]):
                    for start, end in np.frombuffer(raw or b"", np.int64).reshape(-1, 2):
                        edges[bounds[text] + start] += 1
                        edges[bounds[text] + end] -= 1
                # A span that ends with its text meets the next text's first word, and so 0 is right.
                hit = np.cumsum(edges)[:-1] > 0
                yield _results(batch, low, high, bounds, hit, items, last)

    return search


def _results(batch, low, high, bounds, hit, items, last):
    starts, ends = runs(hit)
    spans = []
    for begin, end in zip(bounds[:-1], bounds[1:]):
        own = slice(np.searchsorted(ends, begin, "right"), np.searchsorted(starts, end))
        cut = np.stack([starts[own].clip(begin, end), ends[own].clip(begin, end)], 1) - begin
        spans.append(cut.astype("<i8").tobytes())
    items = [sorted(set(found)) for found in items]
    if not last:
        return pa.record_batch(
            [
                batch.column("doc_id").slice(low, high - low),
                batch.column("text").slice(low, high - low),
                pa.array(items, pa.list_(pa.string())),
                pa.array(spans, pa.binary()),
            ],
            names=["doc_id", "text", "items", "spans"],
        )
    total = np.concatenate(([0], np.cumsum(hit)))
    n_hit = total[bounds[1:]] - total[bounds[:-1]]
    return pa.record_batch(
        [
            batch.column("doc_id").slice(low, high - low),
            pa.array(np.diff(bounds)),
            pa.array(n_hit.astype(np.int64)),
            pa.array([len(found) for found in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(found).encode()).hexdigest() for found in items]),
            pa.array(n_hit > 0),
            pa.array(items, pa.list_(pa.string())),
            pa.array(spans, pa.binary()),
        ],
        names=[
            "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans",
        ],
    )


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of a test item occurs."""
    at = docs.columns.index(text_column)
    context = docs.sparkSession.sparkContext

    def keeper(spread):
        def keep(batches):
            block = spread.value
            for batch in batches:
                for low, high, data, offsets in text_chunks(batch.column(at)):
                    word, bounds = words(data, offsets)
                    clean = np.ones(high - low, bool)
                    for patterns in block.patterns:
                        clean[row_of(bounds, patterns.find(word, bounds)[0])] = False
                    yield batch.slice(low, high - low).filter(pa.array(clean))

        return keep

    for block in item_blocks(benchmark, item_column, item_text, block_bytes):
        docs = docs.mapInArrow(keeper(context.broadcast(block)), docs.schema)
    return docs

"""Token counts of the fields or sections of a text, from one encoding of the whole text.

A text is encoded once; every token has a span of characters.  Sections are spans of characters
too, and the two are joined by their places.  A token that crosses a boundary goes to one section
by an explicit rule:

* ``first``: the section of its first character;
* ``last``: the section of its last character;
* ``most``: the section with most of its characters, the earlier one of equals.

Tokens that share one character (its bytes) each have the span of that character.  So the counts of
all sections add up to the tokens of the whole text, under every rule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sheafwork.llm.arrays import text_chunks
from sheafwork.llm.tokens import encoder, tokenizer_path

RULES = ("first", "last", "most")

SECTION_SCHEMA = (
    "doc_id bigint, section bigint, start bigint, end bigint, n_tokens bigint, n_crossing bigint"
)


def attribute(spans: np.ndarray, bounds: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Section of each token and whether it crosses, for sections between ``bounds``.

    ``bounds`` are increasing; the first is 0 and the last the length of the text.
    """
    sections = max(1, len(bounds) - 1)
    starts, ends = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    first = np.clip(np.searchsorted(bounds, starts, "right") - 1, 0, sections - 1)
    last = np.clip(np.searchsorted(bounds, ends - 1, "right") - 1, 0, sections - 1)
    crossing = last > first
    if rule == "first" or not crossing.any():
        return first, crossing
    if rule == "last":
        return last, crossing
    chosen = first.copy()
    for i in np.flatnonzero(crossing):
        over = np.arange(first[i], last[i] + 1)
        shared = np.minimum(bounds[over + 1], ends[i]) - np.maximum(bounds[over], starts[i])
        chosen[i] = over[int(np.argmax(shared))]
    return chosen, crossing


def line_bounds(text: str) -> np.ndarray:
    """Sections are lines, each with the line feed that ends it."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    cuts = np.flatnonzero(points == 10) + 1
    return np.unique(np.concatenate(([0], cuts, [len(points)])))


def section_tokens(
    docs: DataFrame,
    rule: str = "first",
    tokenizer: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document and line: its span, its tokens, and those of them that cross its edge.

    A null or empty text has one section without characters and tokens.  A repeated row gives its
    sections again.  Other columns are neither read nor returned.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer or tokenizer_path()

    def count(batches):
        model = encoder(path)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            valid = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for low, high, _, _ in text_chunks(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(low, high - low).to_pylist()]
                _, spans, where = model.encode(texts)
                parts = []
                for row, text in enumerate(texts):
                    bounds = line_bounds(text)
                    if len(bounds) == 1:
                        bounds = np.array([0, 0])
                    section, crossing = attribute(spans[where[row] : where[row + 1]], bounds, rule)
                    size = len(bounds) - 1
                    part = np.empty((size, 6), np.int64)
                    part[:, 0] = low + row
                    part[:, 1] = np.arange(size)
                    part[:, 2], part[:, 3] = bounds[:-1], bounds[1:]
                    part[:, 4] = np.bincount(section, minlength=size)
                    part[:, 5] = np.bincount(section[crossing], minlength=size)
                    parts.append(part)
                rows = np.concatenate(parts)
                own = rows[:, 0]
                yield pa.record_batch(
                    [
                        pa.array(ids[own].astype(np.int64), pa.int64(), mask=~valid[own]),
                        *(pa.array(rows[:, k]) for k in range(1, 6)),
                    ],
                    names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"],
                )

    source = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")
    )
    return source.mapInArrow(count, SECTION_SCHEMA)

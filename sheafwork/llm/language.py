"""Language identification by prediction by partial matching (PPM) over bytes.

For each language a tree of byte contexts up to order 3 counts which byte follows.  With the
counts frozen, the code length of a byte is found from its longest known context: the byte's own
share there (method C: count / (all + distinct)), or the context's escape and then the code length
in the context one byte shorter, down to a uniform choice of 256.  A text's code length under a
language is the sum over its bytes; the language with the shortest code wins.

Because the statistics are frozen, every (context, byte) has a fixed code length.  The driver
computes those that the sample holds once, for all languages at once; scoring a text is a look-up
per byte, and only bytes that no language has seen in their context escape while they are scored.
The tree keeps every context and every succession of the sample, and all 256 bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sheafwork.llm.arrays import text_chunks

#: Texts per language that a model is fitted on, about; they are chosen by a hash of their key.
SAMPLE_TEXTS = 2000
#: Contexts overlap, so code lengths overstate the evidence; the score divides them by this.
TEMPERATURE = 8.0

UNKNOWN = "und"
#: Bytes whose code lengths are held at once.
BLOCK_BYTES = 1 << 18


class GramTable:
    """Places of distinct 32-bit keys, found by hash.

    A slot holds one key; those that lose their slot go to a further table with another multiplier,
    so the tables get smaller until every key has a place.  A key that is found is compared.
    """

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys.astype(np.uint32), np.uint32(0))
        self.tables: list[tuple[np.uint32, np.uint32, np.ndarray]] = []
        left = np.arange(len(keys))
        multipliers = np.random.default_rng(1)
        while len(left):
            bits = max(4, int(len(left) * 2).bit_length())
            shift = np.uint32(32 - bits)
            factor = np.uint32(int(multipliers.integers(1 << 31)) * 2 + 1)
            slots = np.full(1 << bits, len(keys), np.int32)
            place = (self.keys[left] * factor) >> shift
            slots[place] = left
            self.tables.append((factor, shift, slots))
            left = left[slots[place] != left]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for one that is not there."""
        found = np.full(len(keys), -1, np.int32)
        at = np.arange(len(keys))
        for factor, shift, slots in self.tables:
            wanted = keys[at]
            place = slots[(wanted * factor) >> shift]
            same = (self.keys[place] == wanted) & (place < len(self.keys) - 1)
            found[at[same]] = place[same]
            at = at[~same]
            if not len(at):
                break
        return found


@dataclass
class LanguageModel:
    """Code lengths in bits, one column a language; bytes are the last of a key, contexts before it."""

    languages: list[str]
    #: Four bytes that some language has seen, and the code length of the last after the others.
    fours: GramTable
    four_bits: np.ndarray
    #: Three bytes: the code length of the last, and the escape from all three as a context.
    threes: GramTable
    three_bits: np.ndarray
    three_escape: np.ndarray
    #: For all pairs of bytes.
    two_bits: np.ndarray
    two_escape: np.ndarray

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each four."""
        place = self.fours.find(grams)
        rows = self.four_bits[place]
        missed = np.flatnonzero(place < 0)
        if len(missed):
            rows[missed] = self._escaped(grams[missed])
        return rows

    def _escaped(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths of bytes that no language has seen after the three before."""
        context = self.threes.find(grams >> np.uint32(8))
        rows = np.where((context >= 0)[:, None], self.three_escape[context], np.float32(0))
        place = self.threes.find(grams & np.uint32(0xFFFFFF))
        shorter = self.two_escape[(grams >> np.uint32(8)) & np.uint32(0xFFFF)] + self.two_bits[grams & np.uint32(0xFFFF)]
        return rows + np.where((place >= 0)[:, None], self.three_bits[place], shorter)

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text under each language."""
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(data) or not self.languages:
            return total
        grams = _grams(data, offsets)
        filled = np.flatnonzero(np.diff(offsets) > 0)
        starts = offsets[filled]
        # A long text is taken in blocks; each adds to the texts that it holds a part of.
        for low in range(0, len(grams), BLOCK_BYTES):
            rows = self.bits(grams[low : low + BLOCK_BYTES])
            first = np.searchsorted(starts, low, "right") - 1
            last = np.searchsorted(starts, low + len(rows))
            held = np.maximum(starts[first:last] - low, 0)
            total[filled[first:last]] += np.add.reduceat(rows, held, axis=0, dtype=np.float64)
        return total


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the three before it; line feeds stand before a text."""
    padded = np.full(len(data) + 3, 10, np.uint8)
    padded[3:] = data
    wide = padded.astype(np.uint32)
    grams = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    starts = offsets[:-1][np.diff(offsets) > 0]
    for step, keep in enumerate((0xFF, 0xFFFF, 0xFFFFFF)):
        at = starts + step
        ends = offsets[1:][np.diff(offsets) > 0]
        at = at[at < ends]
        fill = np.uint32(0x0A0A0A00 & ~keep)
        grams[at] = (grams[at] & np.uint32(keep)) | fill
    return grams


def count_grams(texts: DataFrame) -> DataFrame:
    """Counts per language of each byte with its three predecessors, from (text, lang)."""

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for low, high, data, offsets in text_chunks(batch.column(0)):
                grams = _grams(data, offsets)
                row = np.repeat(np.arange(low, high), np.diff(offsets))
                for lang in sorted(set(langs[low:high])):
                    seen, n = np.unique(grams[(langs == lang)[row]], return_counts=True)
                    yield pa.record_batch(
                        [
                            pa.array([lang] * len(seen), pa.string()),
                            pa.array(seen.astype(np.int64)),
                            pa.array(n.astype(np.int64)),
                        ],
                        names=["lang", "gram", "n"],
                    )

    counted = texts.select("text", "lang").mapInArrow(count, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def bounded_sample(texts: DataFrame, key: str, label: str, bound: int = SAMPLE_TEXTS) -> DataFrame:
    """About ``bound`` rows per label, by a hash of the key: the same ones at every run."""
    sizes = {r[0]: r[1] for r in texts.groupBy(label).count().collect()}
    space = 1 << 20
    share: Column = F.lit(space)
    for value, rows in sizes.items():
        share = F.when(F.col(label) == value, F.lit(int(space * bound / rows) + 1)).otherwise(share)
    return texts.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(space)) < share)


def fit_languages(texts: DataFrame, key: str = "doc_id", sample_texts: int = SAMPLE_TEXTS) -> LanguageModel:
    """Fit on a bounded sample of (key, text, lang); rows without text or language are left out.

    What the driver gets is the counts of that sample, so its size does not grow with the table.
    """
    known = texts.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = count_grams(bounded_sample(known, key, "lang", sample_texts)).toArrow()
    lang = np.array(counts.column("lang").to_pylist(), dtype=object)
    return build_model(lang, counts.column("gram").to_numpy(), counts.column("n").to_numpy())


def build_model(lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> LanguageModel:
    """The model of counted successions: ``n`` times the last byte of ``gram`` after the three before."""
    languages = sorted(set(lang))
    fours = np.unique(gram)
    threes = np.union1d(gram >> 8, gram & 0xFFFFFF)
    width = max(1, len(languages))
    four_bits = np.zeros((len(fours) + 1, width), np.float32)
    three_bits, three_escape = (np.zeros((len(threes) + 1, width), np.float32) for _ in range(2))
    two_bits, two_escape = (np.zeros((1 << 16, width), np.float32) for _ in range(2))
    for k, name in enumerate(languages):
        own, times = gram[lang == name], n[lang == name]
        # Counts of (context, byte) for contexts of 0 to 3 bytes, then lengths from short to long.
        one, _ = _code_lengths(np.arange(256), own & 0xFF, times, np.full(256, 8.0), np.zeros(1, np.int64))
        two, after_one = _code_lengths(
            np.arange(1 << 16), own & 0xFFFF, times, np.tile(one, 256), np.arange(256)
        )
        two_bits[:, k] = two
        three, after_two = _code_lengths(threes, own & 0xFFFFFF, times, two[threes & 0xFFFF], np.arange(1 << 16))
        three_bits[:-1, k], two_escape[:, k] = three, after_two
        four, after_three = _code_lengths(
            fours, own, times, three[np.searchsorted(threes, fours & 0xFFFFFF)], threes
        )
        four_bits[:-1, k], three_escape[:-1, k] = four, after_three
    return LanguageModel(
        languages, GramTable(fours), four_bits, GramTable(threes), three_bits, three_escape, two_bits, two_escape
    )


def _code_lengths(
    keys: np.ndarray, seen: np.ndarray, times: np.ndarray, shorter: np.ndarray, contexts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Code length of each key's last byte after the others, and of the escape from each context.

    ``seen`` are the keys that were counted, ``shorter`` the code lengths of the keys' last bytes in
    the context one byte shorter.  Keys and contexts are sorted.  A context never seen escapes for nothing.
    """
    counts = np.bincount(np.searchsorted(keys, seen), weights=times, minlength=len(keys))
    context = keys >> 8
    place = np.searchsorted(contexts, context) if len(contexts) else context
    known = counts > 0
    total = np.bincount(place[known], weights=counts[known], minlength=len(contexts))
    distinct = np.bincount(place[known], minlength=len(contexts))
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
        own = -np.log2(counts / (total + distinct)[place])
    return np.where(known, own, escape[place] + shorter), escape


def decide(
    model: LanguageModel, data: np.ndarray, offsets: np.ndarray, lettered: pa.Array
) -> tuple[np.ndarray, np.ndarray]:
    """Place of each text's language in the model, one past the last for ``und``, and code lengths."""
    count = len(model.languages)
    lengths = model.lengths(data, offsets) if count else np.zeros((len(offsets) - 1, 1))
    best = np.minimum(lengths.argmin(1), count)
    return np.where(lettered.to_numpy(zero_copy_only=False), best, count), lengths


def predict_language(
    docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: its language, the score (0 to 1), and bits per byte.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.  Of
    languages with equal code lengths the first by name is taken.  Only id and text are read.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        known = spread.value
        for batch in batches:
            ids = batch.column(0)
            lettered = batch.column(2)
            for low, high, data, offsets in text_chunks(batch.column(1)):
                best, lengths = decide(known, data, offsets, lettered.slice(low, high - low))
                excess = (lengths - lengths.min(1, keepdims=True)) * np.log(2) / TEMPERATURE
                score = 1 / np.exp(-excess).sum(1)
                names = np.array([*known.languages, UNKNOWN], dtype=object)
                decided = best < len(known.languages)
                size = np.maximum(1, np.diff(offsets))
                yield pa.record_batch(
                    [
                        ids.slice(low, high - low),
                        pa.array(names[best], pa.string()),
                        pa.array(np.where(decided, score, 0.0)),
                        pa.array(np.where(decided, lengths.min(1) / size, 0.0)),
                    ],
                    names=["doc_id", "lang_pred", "score", "bits_per_byte"],
                )

    source = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        F.col(text_column).alias("text"),
        F.coalesce(F.col(text_column).rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )
    return source.mapInArrow(
        predict, "doc_id bigint, lang_pred string, score double, bits_per_byte double"
    )


def keep_identified(docs: DataFrame, model: LanguageModel, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is not ``und``."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)

    def keep(batches):
        known = spread.value
        for batch in batches:
            lettered = batch.column(batch.num_columns - 1)
            rows = batch.select(range(batch.num_columns - 1))
            for low, high, data, offsets in text_chunks(batch.column(at)):
                best, _ = decide(known, data, offsets, lettered.slice(low, high - low))
                identified = best < len(known.languages)
                yield rows.slice(low, high - low).filter(pa.array(identified))

    lettered = F.coalesce(F.col(f"`{text_column}`").rlike(r"\p{L}"), F.lit(False))
    return docs.select("*", lettered.alias("_lettered")).mapInArrow(keep, docs.schema)

"""Exact removal of repeated byte strings by prefix-free parsing.

A text is parsed into phrases at triggers of a rolling hash: the trigger of a string of ``length``
bytes is its substring of ``TRIGGER`` bytes with the least hash, so the parse follows the content and
equal strings fall into equal phrases, wherever they are.  A phrase is a run of positions with one
trigger, extended by the bytes their strings reach over; different phrases are the dictionary.

The suffixes of the dictionary are ordered by their first ``length`` bytes: equal ones meet, and with
the parse (the smallest document of each phrase) give the first document of every string that
can repeat.  Three things keep this small and spread out:

* a phrase whose trigger occurs in one document only has no repeated string and is left out, so
  of unique text only a short hash per phrase is moved;
* before anything is moved, what a batch of texts has in common is reduced to its smallest document;
* phrases of a frequent trigger are moved string by string, so that no task gets all phrases around
  it.  Which triggers are frequent is estimated on a sample of texts, and only says how a phrase is
  moved: every string meets its equals either way.

Strings are compared by 64-bit hashes.  Results travel as packed arrays, by document.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from sheafwork.llm.arrays import Slices, mix, ranges, runs, text_chunks
from sheafwork.llm.tables import partitions

LENGTH = 50
TRIGGER = 24
#: Positions in a phrase at most.
PHRASE = 4096
#: Bytes of text that are reduced together before anything is moved.
BATCH_BYTES = 8 << 20
#: Bytes of repeated phrases for the same.
CONTENT_BYTES = 16 << 20
#: A trigger is frequent if this share of the sampled texts, and this many, have it or one of its slot.
FREQUENT_SHARE, FREQUENT_TEXTS = 0.001, 8
#: One text in so many is sampled for that, and triggers are counted in so many slots.
SAMPLED, SLOTS = 16, 1 << 20
#: Shares of its dictionary that a task orders one after another.
SHARES = 8

_COLUMNS = ("doc_ids", "texts", "counts", "keys", "starts", "sizes", "content")
#: Packed entries on their way: to the part of their key, or, once found, to that of their document.
_PACKED = "part int, found boolean, " + ", ".join(f"{c} binary" for c in _COLUMNS)
_FOUND = "doc_id bigint, found array<struct<text_hash:bigint,hits:binary>>"


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers byte plane by byte plane, which compresses well."""
    return np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), -1).T).tobytes()


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def phrases(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, trigger: int = TRIGGER):
    """(row, start in the row, positions, trigger hash) of all phrases of texts laid end to end."""
    sizes = np.diff(offsets)
    if len(data) < length or not (sizes >= length).any():
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    least = least_in_windows(Slices(data).windows(trigger), length - trigger + 1)
    count = np.maximum(0, sizes - length + 1)
    at = ranges(offsets[:-1], count)
    row = np.repeat(np.arange(len(sizes)), count)
    least = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    long = np.diff(np.append(begin, len(at)))
    if long.max(initial=0) > PHRASE:
        pieces = -(-long // PHRASE)
        begin = np.repeat(begin, pieces) + ranges(np.zeros(len(begin), np.int64), pieces) * PHRASE
        long = np.diff(np.append(begin, len(at)))
    return row[begin], at[begin] - offsets[row[begin]], long, least[begin]


def _least_per_key(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the smallest document with its key, and the number of documents with it."""
    if not len(keys):
        return docs, docs
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    other = new.copy()
    other[1:] |= d[1:] != d[:-1]
    group = np.cumsum(new) - 1
    least, many = np.empty_like(docs), np.empty(len(docs), np.int64)
    least[order] = d[new][group]
    many[order] = np.bincount(group, weights=other).astype(np.int64)[group]
    return least, many


def _hits(starts: np.ndarray, sizes: np.ndarray) -> bytes:
    return _planes(starts, "<u4") + _planes(sizes, "<u2")


def _from_hits(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    cut = len(raw) // 6 * 4
    return _numbers(raw[:cut], "<u4").astype(np.int64), _numbers(raw[cut:], "<u2").astype(np.int64)


def _send(parts, doc_ids, texts, keys, starts, sizes, body=None, found=False) -> pa.RecordBatch:
    """Entries packed into one row per part, in the order they have.

    ``texts`` may be None; ``body`` is the bytes of all entries and how many each has.
    """
    texts = np.zeros(len(doc_ids), np.int64) if texts is None else texts
    order = np.argsort(parts, kind="stable")
    cuts = np.flatnonzero(np.diff(parts[order], prepend=-1, append=-2))
    at = None if body is None else np.concatenate(([0], np.cumsum(body[1])))
    rows = defaultdict(list)
    for low, high in zip(cuts, cuts[1:]):
        own = order[low:high]
        fresh = np.ones(len(own), bool)
        fresh[1:] = (doc_ids[own][1:] != doc_ids[own][:-1]) | (texts[own][1:] != texts[own][:-1])
        first = np.flatnonzero(fresh)
        rows["part"].append(int(parts[own[0]]))
        rows["doc_ids"].append(_planes(doc_ids[own][first], "<i8"))
        rows["texts"].append(_planes(texts[own][first], "<i8"))
        rows["counts"].append(_planes(np.diff(np.append(first, len(own))), "<u4"))
        rows["keys"].append(None if keys is None else keys[own].tobytes())
        rows["starts"].append(_planes(starts[own], "<u4"))
        rows["sizes"].append(_planes(sizes[own], "<u2"))
        rows["content"].append(
            None if body is None else zstandard.ZstdCompressor(level=3).compress(body[0][ranges(at[own], body[1][own])].tobytes())
        )
    return pa.record_batch(
        [
            pa.array(rows["part"], pa.int32()),
            pa.array([found] * len(rows["part"]), pa.bool_()),
            *(pa.array(rows[c], pa.binary()) for c in _COLUMNS),
        ],
        names=["part", "found", *_COLUMNS],
    )


def _answer(parts: int, doc_ids, texts, starts, sizes) -> pa.RecordBatch:
    """What was found, packed by the part of the document."""
    part = (mix(doc_ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((starts, doc_ids))
    texts = None if texts is None else texts[order]
    return _send(part[order], doc_ids[order], texts, None, starts[order], sizes[order], found=True)


def _parse(parts: int, length: int, trigger: int):
    """Texts to triggers: those shared inside a batch are answered, one of each is moved."""

    def flush(held):
        doc, start, size, key = (np.concatenate(column) for column in zip(*held))
        least, many = _least_per_key(key, doc)
        shared = many > 1
        if shared.any():
            yield _answer(parts, doc[shared], None, start[shared], size[shared])
        own = doc == least
        part = (key[own] % np.uint64(parts)).astype(np.int64)
        high = (key[own] >> np.uint64(32)).astype("<u4")
        # A size of 0 says that the phrase is shared inside its batch, and answered already.
        yield _send(part, doc[own], None, high, start[own], np.where(shared[own], 0, size[own]))

    def parse(batches):
        held, taken = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for low, high, data, offsets in text_chunks(batch.column(2)):
                row, start, size, key = phrases(data, offsets, length, trigger)
                if len(row):
                    held.append((ids[low + row], start, size, key))
                taken += len(data)
                if taken >= BATCH_BYTES and held:
                    yield from flush(held)
                    held, taken = [], 0
        if held:
            yield from flush(held)

    return parse


def _by_part(rows: list[dict]):
    """(documents, texts, rows, starts, sizes) of the entries of each part."""
    parts = defaultdict(list)
    for row in rows:
        parts[row["part"]].append(row)
    for own in parts.values():
        counts = [_numbers(r["counts"], "<u4").astype(np.int64) for r in own]
        yield (
            np.concatenate([np.repeat(_numbers(r["doc_ids"], "<i8"), c) for r, c in zip(own, counts)]),
            np.concatenate([np.repeat(_numbers(r["texts"], "<i8"), c) for r, c in zip(own, counts)]),
            own,
            np.concatenate([_numbers(r["starts"], "<u4") for r in own]).astype(np.int64),
            np.concatenate([_numbers(r["sizes"], "<u2") for r in own]).astype(np.int64),
        )


def _meeting(solve):
    """A step that passes on what is found and gives the moved entries of a part to ``solve``."""

    def meet(batches):
        moved: list[dict] = []
        for batch in batches:
            found = batch.column("found")
            yield batch.filter(found)
            moved += batch.filter(pc.invert(found)).to_pylist()
        yield from solve(moved)

    return meet


def _repeated_triggers(parts: int):
    """Triggers in two documents or more, from the entries of all batches."""

    def solve(moved):
        for doc, _, rows, start, size in _by_part(moved):
            key = np.concatenate([np.frombuffer(r["keys"], "<u4") for r in rows])
            inside = size == 0
            _, many = _least_per_key(key, doc)
            marked = np.isin(key, key[inside])
            wanted = ((many > 1) | marked) & ~inside
            yield _answer(parts, doc[wanted], None, start[wanted], size[wanted])

    return _meeting(solve)


def _by_document(batches):
    """One row per document, with all that was found in it."""
    packed = [row for batch in batches for row in batch.to_pylist()]
    for doc, text, _, start, size in _by_part(packed):
        order = np.lexsort((start, text, doc))
        doc, text, start, size = doc[order], text[order], start[order], size[order]
        new = np.ones(len(doc), bool)
        new[1:] = doc[1:] != doc[:-1]
        fresh = new.copy()
        fresh[1:] |= text[1:] != text[:-1]
        first = np.flatnonzero(fresh)
        ends = np.append(first[1:], len(doc))
        hits = [_hits(start[a:b], size[a:b]) for a, b in zip(first, ends)]
        values = pa.StructArray.from_arrays(
            [pa.array(text[first], pa.int64()), pa.array(hits, pa.binary())], names=["text_hash", "hits"]
        )
        lists = np.append(np.flatnonzero(new[first]), len(first)).astype(np.int32)
        yield pa.record_batch(
            [pa.array(doc[new]), pa.ListArray.from_arrays(pa.array(lists), values)], names=["doc_id", "found"]
        )


def _slot(key: np.ndarray) -> np.ndarray:
    return (key % np.uint64(SLOTS)).astype(np.int64)


def frequent_slots(texts: DataFrame, length: int, trigger: int) -> np.ndarray:
    """Which slots of triggers are frequent in a sample of (doc_id, text_hash, text).

    At most (phrases per text) / FREQUENT_SHARE slots are collected, however many texts there are.
    """
    sample = texts.where(F.pmod("text_hash", F.lit(SAMPLED)) == 0)

    def count(batches):
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(2)):
                row, _, _, key = phrases(data, offsets, length, trigger)
                pairs = np.unique(np.stack([row, _slot(key)], 1), axis=0)
                slot, n = np.unique(pairs[:, 1], return_counts=True)
                yield pa.record_batch([pa.array(slot), pa.array(n)], names=["slot", "n"])

    least = max(FREQUENT_TEXTS, int(sample.count() * FREQUENT_SHARE))
    counts = sample.mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    found = np.zeros(SLOTS, bool)
    found[counts.where(F.col("n") >= least).select("slot").toArrow().column(0).to_numpy()] = True
    return found


def _dictionary(parts: int, length: int, trigger: int, slots):
    """Phrases with repeated triggers to dictionary entries, each with its first document here."""

    def candidates(found, ids, texts, low, high, offsets):
        columns = [[], [], [], [], []]
        for row in range(low, high):
            base, end = offsets[row - low], offsets[row - low + 1]
            for hit in found[row].as_py() or ():
                start, size = _from_hits(hit["hits"])
                # Rows with one id share their hints; those of another, longer text are left out.
                fits = base + start + size + length - 1 <= end
                own = (ids[row], texts[row], start[fits], size[fits], base)
                for column, value in zip(columns, own):
                    column.append(np.broadcast_to(value, int(fits.sum())))
        return [np.concatenate(c) for c in columns] if columns[0] else None

    def entries(data, doc, text, start, size, base):
        """Phrases of a chunk that are moved whole, and strings that are moved one by one."""
        slices = Slices(data)
        hashes = slices.windows(trigger)
        near = np.lib.stride_tricks.sliding_window_view(hashes, length - trigger + 1)
        key = near[base + start].min(1)
        often = slots.value[_slot(key)]
        w = ~often
        width = size[w] + length - 1
        content = slices.hash(base[w] + start[w], base[w] + start[w] + width)
        body = data[ranges(base[w] + start[w], width)]
        whole = (doc[w], text[w], start[w], size[w], key[w], content, body)
        count = size[often]
        begin = ranges(start[often], count)
        at = np.repeat(base[often], count) + begin
        single = (np.repeat(doc[often], count), np.repeat(text[often], count), begin, slices.hash(at, at + length))
        return whole, single

    def flush(wholes, singles):
        doc, text, start, size, key, content, body = (np.concatenate(c) for c in zip(*wholes))
        least, _ = _least_per_key(content, doc)
        covered = doc > least
        if covered.any():
            yield _answer(parts, doc[covered], text[covered], start[covered], size[covered])
        own = ~covered
        if own.any():
            width = size + length - 1
            kept = body[ranges((np.cumsum(width) - width)[own], width[own])], width[own]
            part = (mix(key[own]) % np.uint64(parts)).astype(np.int64)
            yield _send(part, doc[own], text[own], key[own], start[own], size[own], kept)
        doc, text, start, key = (np.concatenate(c) for c in zip(*singles))
        least, _ = _least_per_key(key, doc)
        seen = doc > least
        if seen.any():
            yield _answer(parts, doc[seen], text[seen], start[seen], np.ones(int(seen.sum()), np.int64))
        own = ~seen
        if own.any():
            part = (mix(key[own]) % np.uint64(parts)).astype(np.int64)
            none = np.zeros(len(part), np.int64)
            yield _send(part, doc[own], text[own], key[own], start[own], none)

    def enter(batches):
        wholes, singles, taken = [], [], 0
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            texts = batch.column(1).to_numpy()
            for low, high, data, offsets in text_chunks(batch.column(2)):
                columns = candidates(batch.column(3), ids, texts, low, high, offsets)
                if not columns or not len(columns[0]):
                    continue
                whole, single = entries(data, *columns)
                wholes.append(whole)
                singles.append(single)
                taken += len(whole[-1]) + 32 * len(single[0])
                if taken >= CONTENT_BYTES:
                    yield from flush(wholes, singles)
                    wholes, singles, taken = [], [], 0
        if wholes:
            yield from flush(wholes, singles)

    return enter


def _first_documents(parts: int, length: int):
    """Order the suffixes of the dictionary by their strings; answer where an earlier document has one.

    Equal strings have equal keys, so the entries of a part are taken share by share of their keys.
    """

    def solve(moved):
        for doc, text, rows, start, size in _by_part(moved):
            key = np.concatenate([np.frombuffer(r["keys"], "<u8") for r in rows])
            body = np.frombuffer(
                b"".join(zstandard.ZstdDecompressor().decompress(r["content"]) if r["content"] else b"" for r in rows),
                np.uint8,
            )
            width = np.where(size > 0, size + length - 1, 0)
            at = np.cumsum(width) - width
            share = (mix(key) >> np.uint64(40)) % np.uint64(SHARES)
            found = []
            for n in range(SHARES):
                own = np.flatnonzero(share == n)
                count = np.maximum(size[own], 1)
                entry = np.repeat(own, count)
                step = ranges(np.zeros(len(own), np.int64), count)
                string = key[entry]
                inside = size[entry] > 0
                if inside.any():
                    mine = own[size[own] > 0]
                    text_of = body[ranges(at[mine], width[mine])]
                    begin = np.repeat(np.cumsum(width[mine]) - width[mine], size[mine]) + step[inside]
                    string[inside] = Slices(text_of).hash(begin, begin + length)
                least, _ = _least_per_key(string, doc[entry])
                hit = doc[entry] > least
                entry, step = entry[hit], step[hit]
                place, runs_of = _joined(entry, step)
                entry, step = entry[place], step[place]
                found.append((doc[entry], text[entry], start[entry] + step, runs_of))
            yield _answer(parts, *(np.concatenate(column) for column in zip(*found)))

    return _meeting(solve)


def _joined(entry: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the runs of neighbouring steps of one entry, and their lengths."""
    fresh = np.ones(len(entry), bool)
    fresh[1:] = (entry[1:] != entry[:-1]) | (step[1:] != step[:-1] + 1)
    first = np.flatnonzero(fresh)
    return first, np.diff(np.append(first, len(entry)))


def _meet(df: DataFrame, step, tasks: int) -> DataFrame:
    """Entries and answers meet by part, then all answers by document: (doc_id, found)."""
    solved = df.repartitionById(tasks, F.col("part")).mapInArrow(step, _PACKED)
    return solved.repartitionById(tasks, F.col("part")).mapInArrow(_by_document, _FOUND)


def find_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = LENGTH,
    trigger: int = TRIGGER,
) -> DataFrame:
    """One row per row of ``docs``: bytes, removed bytes and runs, the kept bytes and their SHA-256.

    A byte is removed if it lies in a string of ``length`` bytes that also starts in a document with
    a smaller id.  A null or short text keeps all its bytes, as does a row without an id, which is
    not compared.  Rows with one id are not compared with each other.  The kept bytes are returned as
    ``kept`` and the removed runs as ``removed``, pairs of 64-bit numbers.
    """
    tasks = partitions(docs.sparkSession)
    source = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        F.xxhash64(text_column).alias("text_hash"),
        F.col(text_column).alias("text"),
    )
    named = source.where("doc_id is not null")
    slots = docs.sparkSession.sparkContext.broadcast(frequent_slots(named, length, trigger))
    parsed = named.mapInArrow(_parse(tasks, length, trigger), _PACKED)
    candidates = _meet(parsed, _repeated_triggers(tasks), tasks)
    # Both joins read the documents from one exchange by id.
    entered = source.join(candidates.hint("shuffle_hash"), "doc_id", "left").mapInArrow(
        _dictionary(tasks, length, trigger, slots), _PACKED
    )
    repeats = _meet(entered, _first_documents(tasks, length), tasks)
    marked = source.join(repeats.hint("shuffle_hash"), "doc_id", "left")
    return marked.mapInArrow(
        _remove(length),
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
        "kept binary, removed binary",
    )


def _remove(length: int):
    def remove(batches):
        for batch in batches:
            texts = batch.column(1).to_numpy(zero_copy_only=False)
            found = batch.column(3)
            for low, high, data, offsets in text_chunks(batch.column(2)):
                edges = np.zeros(len(data) + 1, np.int64)
                for row in range(low, high):
                    for hit in found[row].as_py() or ():
                        if hit["text_hash"] == texts[row]:
                            start, size = _from_hits(hit["hits"])
                            start = start + offsets[row - low]
                            np.add.at(edges, start, 1)
                            np.add.at(edges, start + size + length - 1, -1)
                gone = np.cumsum(edges)[:-1] > 0
                rows = defaultdict(list)
                for begin, end in zip(offsets, offsets[1:]):
                    own = gone[begin:end]
                    starts, ends = runs(own)
                    kept = data[begin:end][~own].tobytes()
                    rows["n_bytes"].append(end - begin)
                    rows["n_removed"].append(int(own.sum()))
                    rows["n_spans"].append(len(starts))
                    rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    rows["kept"].append(kept)
                    rows["removed"].append(np.stack([starts, ends], 1).astype("<i8").tobytes())
                yield pa.record_batch(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(rows["n_bytes"], pa.int64()),
                        pa.array(rows["n_removed"], pa.int64()),
                        pa.array(rows["n_spans"], pa.int64()),
                        pa.array(rows["kept_sha256"], pa.string()),
                        pa.array(rows["kept"], pa.binary()),
                        pa.array(rows["removed"], pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"],
                )

    return remove

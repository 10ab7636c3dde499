"""Best-fit packing of token sequences, certified by lower bounds from dual feasible functions.

Documents are encoded once into pieces of at most ``capacity`` tokens.  The pieces are dealt over
groups of bounded size; each group is packed by best-fit decreasing and gets a lower bound for its
number of sequences.  A group that meets its bound is optimal and final.  In the other groups the
full sequences stay, and the pieces of all others are exchanged: they are dealt anew over as many
groups as their number asks for and packed again, until every group meets its bound, one group is left,
or a round saves nothing more.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sheafwork.llm.arrays import text_chunks
from sheafwork.llm.tables import shared
from sheafwork.llm.tokens import encoder, tokenizer_path

CAPACITY = 2048
#: Pieces dealt to a group.
GROUP_PIECES = 100_000
#: Rounds of exchange at most.
ROUNDS = 6

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def encode_pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str | None = None,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: its document, number, first token, length and the CRC-32 of its ids.

    A document is the ids of its text, then ``end_id``; a null or empty text is ``end_id`` alone.
    A document beyond the capacity is cut into full pieces, the first takes what does not fill one.
    Rows that repeat a document are packed each on their own.
    """
    path = tokenizer or tokenizer_path()

    def encode(batches):
        model = encoder(path)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for low, high, _, _ in text_chunks(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(low, high - low).to_pylist()]
                ids, _, where = model.encode(texts, with_spans=False)
                ids = ids.astype("<u4")
                out = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
                for row in range(high - low):
                    whole = np.append(ids[where[row] : where[row + 1]], np.uint32(end_id))
                    whole = whole.astype("<u4")
                    first = len(whole) % capacity or capacity
                    cuts = [0, *range(first, len(whole) + 1, capacity)]
                    for piece, (start, end) in enumerate(zip(cuts, cuts[1:])):
                        out["doc_id"].append(doc_ids[low + row])
                        out["piece"].append(piece)
                        out["start"].append(start)
                        out["length"].append(end - start)
                        out["ids_crc32"].append(zlib.crc32(whole[start:end].tobytes()))
                yield pa.record_batch(
                    [
                        pa.array(out["doc_id"], pa.int64()),
                        pa.array(out["piece"], pa.int32()),
                        pa.array(out["start"], pa.int64()),
                        pa.array(out["length"], pa.int64()),
                        pa.array(out["ids_crc32"], pa.int64()),
                    ],
                    names=list(out),
                )

    source = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")
    )
    return source.mapInArrow(encode, PIECE_SCHEMA)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece.  Longest first, each into the fullest it fits in."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where a sequence has room r
    used = 0
    for i in order.tolist():
        length = int(lengths[i])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            chosen, used, room = used, used + 1, capacity
        bins[i], offsets[i] = chosen, capacity - room
        left = room - length
        if left:
            with_room[left].append(chosen)
            rooms |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """A bound that no packing goes below, the best of a family of dual feasible functions.

    For each threshold t up to half the capacity: pieces above capacity - t count as a whole
    sequence, those below t as nothing, the others by their length.  And for each k: a piece counts
    as floor((k + 1) * length / capacity) of k parts, or by its length where that is a whole number.
    """
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1)
    number, mass = np.cumsum(count), np.cumsum(count * size)
    t = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - t]
    between = mass[capacity - t] - np.where(t > 0, mass[np.maximum(t - 1, 0)], 0)
    best = int((large + -(-between // capacity)).max())
    for k in range(1, 21):
        scaled = (k + 1) * size
        share = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, int(-(-(count * share).sum() // (capacity * k))))
    return best


def _pack_group(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    frame = frame.sort_values(
        ["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True]
    )
    lengths = frame["length"].to_numpy(np.int64)
    bins, offsets = best_fit_decreasing(lengths, capacity)
    gap = int(bins.max()) + 1 - lower_bound(lengths, capacity)
    fill = np.bincount(bins, weights=lengths)
    return frame.assign(
        bin=bins, offset=offsets, gap=gap, full=fill[bins] >= capacity, fill=fill[bins].astype(np.int64)
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Give each row with a ``length`` a ``sequence_id`` and an ``offset``.

    An empty table gives an empty one; a length beyond the capacity is an error.
    """
    columns = pieces.schema
    open_pieces = shared(pieces, "pieces")
    total = open_pieces.count()
    groups = max(1, -(-total // group_pieces))
    schema = f"{_ddl(columns)}, bin bigint, offset bigint, gap bigint, full boolean, fill bigint, _group bigint"
    done: list[DataFrame] = []
    best = None
    for turn in range(ROUNDS):
        # The rows of a written table keep their numbers, so a task that is run again deals alike.
        dealt = open_pieces.withColumn(
            "_group",
            F.pmod(F.xxhash64(F.lit(turn), F.monotonically_increasing_id()), F.lit(groups)),
        )
        packed = shared(
            dealt.groupBy("_group").applyInPandas(
                lambda frame: _pack_group(frame, capacity), schema
            ),
            "packed",
        ).withColumn("_turn", F.lit(turn))
        seen = packed.groupBy("_group").agg(
            F.max("gap").alias("gap"), F.countDistinct("bin").alias("bins"),
            F.countDistinct(F.when(~F.col("full"), F.col("bin"))).alias("loose"),
        ).agg(F.sum("gap"), F.sum("bins"), F.sum("loose")).first()
        gap, _, loose = (int(v or 0) for v in seen)
        last = gap == 0 or groups == 1 or (best is not None and loose >= best) or turn == ROUNDS - 1
        if last:
            done.append(packed)
            break
        best = loose
        keep = (F.col("gap") == 0) | F.col("full")
        done.append(packed.where(keep))
        open_pieces = shared(packed.where(~keep).select(*columns.names), "pieces")
        groups = max(1, -(-open_pieces.count() // group_pieces))
    result = done[0]
    for frame in done[1:]:
        result = result.unionByName(frame)
    return result.select(
        *columns.names,
        # Turn, group and place in the group, each in its own bits.
        (F.col("_turn") * F.lit(1 << 59) + F.col("_group") * F.lit(1 << 28) + F.col("bin")).alias(
            "sequence_id"
        ),
        "offset",
    )


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """Encode documents and pack their pieces: the ids stay with the text, which is not moved."""
    return pack(encode_pieces(docs, capacity, **options), capacity)

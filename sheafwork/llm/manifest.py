"""Merkle manifest of a table: a tree of SHA-256 digests whose parents keep their states.

The rows of a group are leaves in a given order.  Every three consecutive nodes (the last run may have
fewer, even one) become their parent, until one is left, the subroot; the subroots, in the order of
their groups, become the root in the same way.  A digest enters its parent as 64 hex digits.

A parent keeps, besides its children, a copy of the hash state before each of them.  To learn the root
for another digest of a leaf, the state before its place is resumed with the new digest and only the
siblings to the right of it, level by level: what lies to the left is never hashed again.

Trees are built in blocks of 3^7 nodes, seven levels at a time, so a task holds one block, whatever the
size of a group; a group of 10^10 rows takes three rounds.  Going down again, each block gets the path of
its top to the root (a few dozen steps) as one value, and its leaves are folded in the task of their block.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sheafwork.llm import sha256
from sheafwork.llm.tables import shared

#: Children of a parent.
ARITY = 3
#: Levels that are built at a time.
BLOCK_LEVELS = 7

#: One step of a path: the place among the children, their number, the state before it, all children.
STEP = np.dtype([("slot", "u1"), ("size", "u1"), ("state", ">u4", 8), ("children", ">u4", (ARITY, 8))])

_PARENT = pa.schema(
    [
        ("tree", pa.int64()), ("block", pa.int64()), ("level", pa.int32()), ("place", pa.int64()),
        ("size", pa.int32()), ("digest", pa.binary()), ("states", pa.binary()), ("children", pa.binary()),
        ("top", pa.bool_()), ("path", pa.binary()),
    ]
)
_PARENT_DDL = (
    "tree bigint, block bigint, level int, place bigint, size int, digest binary, states binary, "
    "children binary, top boolean, path binary"
)
_NODE = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("path", pa.binary())])


class Manifest(NamedTuple):
    """What is kept of a table.

    Leaves (tree, pos, n, digest and the other columns), the parents of the groups' trees and of the
    tree over the subroots, one table per round, and (tree, digest) of the subroots; ``root`` has one row.
    """

    leaves: DataFrame
    rounds: list[DataFrame]
    top_rounds: list[DataFrame]
    subroots: DataFrame
    root: DataFrame
    block_levels: int

    @property
    def width(self) -> int:
        """Leaves of a block."""
        return ARITY**self.block_levels


def field_bytes(value: Column, kind: str) -> Column:
    """A field as it is hashed: its UTF-8 byte count, a colon and the value; ``-`` for a null."""
    plain = (value if kind == "string" else value.cast("string")).cast("binary")
    size = F.concat(F.octet_length(plain).cast("string"), F.lit(":")).cast("binary")
    return F.coalesce(F.concat(size, plain), F.lit(b"-"))


def leaf_digest(fields: list[tuple[Column, str]]) -> Column:
    """SHA-256 (32 bytes) of the fields (value, type) of a row, one after another."""
    return F.unhex(F.sha2(F.concat(*[field_bytes(value, kind) for value, kind in fields]), 256))


def _placed(rows: DataFrame, order: list, group: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Rows in ranges of an order, written, and (range, group, start, first, n) per range and group.

    A row's place in its group is ``_at - first + start``.  ``_at`` counts the rows of a range.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = shared(ordered.withColumn("_id", at), label)
    placed = placed.select(
        *rows.columns, F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at")
    )
    edges = placed.groupBy("_range", *group).agg(F.min("_at").alias("first"), F.count("*").alias("rows"))
    # At most one row per range in a window.
    so_far = Window.partitionBy(*group).orderBy("_range")
    whole = so_far.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return placed, edges.select(
        "_range", *group, "first",
        (F.sum("rows").over(so_far) - F.col("rows")).alias("start"), F.sum("rows").over(whole).alias("n"),
    )


def _binary(words: np.ndarray, width: int = 1) -> pa.Array:
    """Digests (8, n) as binary values of ``width`` digests each."""
    return _fixed(sha256.to_bytes(words), 32 * width)


def _fixed(data: bytes, width: int) -> pa.Array:
    count = len(data) // width
    offsets = np.arange(count + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _joined(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _level(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest, states, children, size) of the parents of the nodes (8, n); states and children (8, 3, m)."""
    count = -(-nodes.shape[1] // ARITY)
    states, children = np.zeros((2, 8, ARITY, count), np.uint32)
    size = np.zeros(count, np.int32)
    state = sha256.fresh(count)
    for slot in range(ARITY):
        child = nodes[:, slot::ARITY]
        held = child.shape[1]
        states[:, slot], children[:, slot, :held] = state, child
        size[:held] += 1
        state = state.copy()
        if held:
            state[:, :held] = sha256.compress(state[:, :held], sha256.hex_block(child))
    return sha256.finish(state, size), states, children, size


def _build(table: pa.Table) -> pa.Table:
    """The parents of one block of nodes (tree, block, pos, levels, digest)."""
    order = np.argsort(table.column("pos").to_numpy(), kind="stable")
    nodes = sha256.from_bytes(_joined(table.column("digest")))[:, order]
    tree, block = table.column("tree")[0].as_py(), table.column("block")[0].as_py()
    levels = table.column("levels")[0].as_py()
    made = []
    for level in range(1 if levels else 0, levels + 1):
        if level:
            nodes, states, children, size = _level(nodes)
        else:
            states = children = np.zeros((8, ARITY, 1), np.uint32)
            size = np.zeros(1, np.int32)
        count = nodes.shape[1]
        per_parent = [np.ascontiguousarray(x.transpose(0, 2, 1)).reshape(8, -1) for x in (states, children)]
        made.append(
            pa.Table.from_arrays(
                [
                    pa.array(np.full(count, tree)), pa.array(np.full(count, block)),
                    pa.array(np.full(count, level, np.int32)), pa.array(np.arange(count)),
                    pa.array(size), _binary(nodes), _binary(per_parent[0], ARITY), _binary(per_parent[1], ARITY),
                    pa.array(np.full(count, level == levels)), pa.nulls(count, pa.binary()),
                ],
                schema=_PARENT,
            )
        )
    return pa.concat_tables(made)


def _levels(n: str) -> Column:
    """How often three become one until ``n`` nodes are one."""
    powers = F.array(*[F.lit(ARITY**k).cast("bigint") for k in range(40)])
    return F.size(F.filter(powers, lambda p: p < F.col(n))).cast("int")


def _grow(nodes: DataFrame, label: str, block_levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The parents of the nodes (tree, pos, n, digest), a table per round, and (tree, digest) of the tops."""
    rounds: list[DataFrame] = []
    width = ARITY**block_levels
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most and (most > 1 or not rounds):
        levels = F.least(F.lit(block_levels), _levels("n")).cast("int").alias("levels")
        blocks = nodes.select("tree", F.expr(f"pos div {width}").alias("block"), "pos", levels, "digest", "n")
        built = blocks.drop("n").groupBy("tree", "block").applyInArrow(_build, _PARENT_DDL)
        rounds.append(shared(built, f"{label}-{len(rounds)}"))
        tops = rounds[-1].where("top").select("tree", F.col("block").alias("pos"), "digest")
        counts = tops.groupBy("tree").agg(F.count("*").alias("n"))
        nodes, most = tops.join(counts, "tree").select("tree", "pos", "n", "digest"), -(-most // width)
    return rounds, nodes.select("tree", "digest")


def build_manifest(
    rows: DataFrame, group: str, order: list[str], digest: str = "digest", block_levels: int = BLOCK_LEVELS
) -> Manifest:
    """The manifest of rows with a digest (32 bytes) each.

    ``group`` may be null, which is a group of its own and the first; the others come in the order of
    their UTF-8 bytes.  Inside a group rows ascend by ``order``, nulls first, then by digest; rows that
    repeat are leaves of their own.  The other columns are carried along.  An empty table has no root.
    """
    known, name = F.col(f"`{group}`").isNotNull(), F.coalesce(F.col(f"`{group}`").cast("string"), F.lit(""))
    keyed = rows.withColumns({"_known": known, "_name": name})
    placed, edges = _placed(keyed, ["_known", "_name", *order, digest], ["_known", "_name"], "leaves")
    edges = shared(edges, "edges")
    groups = edges.groupBy("_known", "_name").agg(F.max("n").alias("n"))
    in_order, spans = _placed(groups, ["_known", "_name"], [], "groups")
    trees = in_order.join(spans, "_range").select(
        "_known", "_name", (F.col("_at") - F.col("first") + F.col("start")).alias("tree")
    )
    spots = edges.join(trees, ["_known", "_name"])
    pos = (F.col("_at") - F.col("first") + F.col("start")).alias("pos")
    leaves = placed.join(spots, ["_range", "_known", "_name"]).select("tree", pos, "n", *rows.columns)
    leaves = shared(leaves, "numbered")
    rounds, subroots = _grow(leaves.select("tree", "pos", "n", F.col(digest).alias("digest")), "parents", block_levels)
    subroots = shared(subroots, "subroots")
    count = subroots.agg(F.count("*").alias("n"))
    tops = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), "digest")
    top_rounds, root = _grow(tops.crossJoin(F.broadcast(count)), "top-parents", block_levels)
    return Manifest(leaves, rounds, top_rounds, subroots, root, block_levels)


class _Block:
    """The parents of one block, level by level, and the path of its top."""

    def __init__(self, parents: pa.Table):
        level = parents.column("level").to_numpy()
        self.above = b""
        self.levels = []
        paths = parents.column("path").to_pylist()
        for k in np.flatnonzero(level == -1).tolist():
            self.above = paths[k]
        for k in range(1, int(level.max()) + 1):
            own = parents.take(np.flatnonzero(level == k))
            own = own.take(np.argsort(own.column("place").to_numpy()))
            states, children = (
                np.frombuffer(_joined(own.column(c)), ">u4").reshape(-1, ARITY, 8).astype(np.uint32)
                for c in ("states", "children")
            )
            self.levels.append((own.column("size").to_numpy(), states, children))

    def steps(self, nodes: np.ndarray) -> np.ndarray:
        """The steps (nodes, levels) of nodes, given by their places in the block."""
        made = np.zeros((len(nodes), len(self.levels)), STEP)
        for k, (size, states, children) in enumerate(self.levels):
            up, slot = np.divmod(nodes, ARITY)
            made["slot"][:, k], made["size"][:, k] = slot, size[up]
            made["state"][:, k], made["children"][:, k] = states[up, slot], children[up]
            nodes = up
        return made


def _paths(key, parents: pa.Table, node: pa.Table, width: int) -> pa.Table:
    """The whole path of each node of a block: its steps in it, then those above."""
    block = _Block(pa.concat_tables([parents.select(_PARENT.names), node.select(_PARENT.names)]))
    count = int(block.levels[0][0].sum()) if block.levels else 1
    made = block.steps(np.arange(count))
    tree, number = key[0].as_py(), key[1].as_py()
    paths = [row.tobytes() + block.above for row in made]
    return pa.Table.from_arrays(
        [pa.array(np.full(count, tree)), pa.array(np.arange(count) + number * width), pa.array(paths, pa.binary())],
        schema=_NODE,
    )


def _as_parents(paths: DataFrame) -> DataFrame:
    """Paths (tree, block, path) as rows of level -1 beside parents."""
    given = {"tree", "block", "path"}
    empty = {"level": "-1"}
    return paths.selectExpr(
        *[f"{n}" if n in given else f"cast({empty.get(n, 'null')} as {t}) as {n}"
          for n, t in (c.split() for c in _PARENT_DDL.split(", "))]
    )


def _node_paths(parents: DataFrame, tops: DataFrame, width: int) -> DataFrame:
    """The paths (tree, pos, path) of all nodes of a round, from those of its blocks (tree, block, path)."""

    def extend(key, parents: pa.Table, node: pa.Table) -> pa.Table:
        return _paths(key, parents, node, width)

    both = parents.groupBy("tree", "block").cogroup(_as_parents(tops).groupBy("tree", "block"))
    return both.applyInArrow(extend, "tree bigint, pos bigint, path binary")


def _down(rounds: list[DataFrame], tops: DataFrame, width: int) -> DataFrame:
    """The paths (tree, block, path) of the blocks of the first round, from those of the last one's."""
    for parents in reversed(rounds[1:]):
        tops = _node_paths(parents, tops, width).withColumnRenamed("pos", "block")
    return tops


def block_paths(manifest: Manifest) -> DataFrame:
    """(tree, block, path): how each block of leaves hangs below the root."""
    spark = manifest.leaves.sparkSession
    root = spark.createDataFrame([(0, 0, b"")], "tree bigint, block bigint, path binary")
    blocks = _down(manifest.top_rounds, root, manifest.width)
    named = _node_paths(manifest.top_rounds[0], blocks, manifest.width)
    tops = named.select(F.col("pos").alias("tree"), F.lit(0).cast("bigint").alias("block"), "path")
    return shared(_down(manifest.rounds, tops, manifest.width), "block-paths")


def _resume(digest: np.ndarray, state: np.ndarray, slot: np.ndarray, size: np.ndarray, children: np.ndarray):
    """Parents' digests (8, n) with ``digest`` in the place ``slot``: from its state on, to the right only."""
    state = sha256.compress(state, sha256.hex_block(digest))
    for right in range(1, ARITY):
        on = np.flatnonzero((slot < right) & (right < size))
        if len(on):
            state[:, on] = sha256.compress(state[:, on], sha256.hex_block(children[on, right].T))
    return sha256.finish(state, size)


def fold_block(digests: np.ndarray, steps: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The roots (8, n) that follow from other digests (8, n) of leaves with the given steps."""
    folded = digests
    for k in range(steps.shape[1]):
        at = steps[:, k]
        folded = _resume(
            folded, np.ascontiguousarray(at["state"].T).astype(np.uint32), at["slot"], at["size"],
            at["children"].astype(np.uint32),
        )
    # Leaves whose digest is unchanged have one top; it is folded once.
    tops, which = np.unique(folded.T, axis=0, return_inverse=True)
    folded = np.ascontiguousarray(tops.T)
    for step in above:
        count = folded.shape[1]
        folded = _resume(
            folded, np.repeat(step["state"].astype(np.uint32)[:, None], count, axis=1),
            np.full(count, step["slot"]), np.full(count, step["size"]),
            np.broadcast_to(step["children"].astype(np.uint32), (count, ARITY, 8)),
        )
    return folded[:, which.ravel()]


def _siblings(step: np.ndarray) -> bytes:
    """The hex digests beside a node, from left to right."""
    words = step["children"]
    return b"".join(
        words[s].tobytes().hex().encode() for s in range(int(step["size"])) if s != int(step["slot"])
    )


def _proofs(block: _Block, leaves: np.ndarray, above: np.ndarray) -> list[bytes]:
    """SHA-256 of all siblings of each leaf, level by level up to the root."""
    rest = b"".join(_siblings(step) for step in above)
    beside = [rest]
    for size, _, children in reversed(block.levels):
        packed = children.astype(">u4")
        texts = [[c.tobytes().hex().encode() for c in row[:n]] for row, n in zip(packed, size.tolist())]
        beside = [
            b"".join(row[:s] + row[s + 1 :]) + beside[k] for k, row in enumerate(texts) for s in range(len(row))
        ]
    return [hashlib.sha256(beside[k]).digest() for k in leaves.tolist()]


def fold_claims(manifest: Manifest, claimed: str, keep: list[str], digest: str = "digest") -> DataFrame:
    """(keep, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf.

    ``claimed`` is the digest (32 bytes) that a leaf is said to have: ``folded_root`` is the root that
    follows from it and the leaf's siblings, ``verified`` says whether that is the root.
    """
    claims = manifest.leaves.select(
        "tree", F.expr(f"pos div {manifest.width}").alias("block"), "pos", F.col(digest).alias("leaf"),
        F.col(claimed).alias("claimed"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)],
    )
    kinds, width = dict(manifest.leaves.dtypes), manifest.width
    kept = ", ".join(f"_k{i} {kinds[c]}" for i, c in enumerate(keep))
    schema = f"tree bigint, leaf binary, proof binary, folded binary, {kept}"
    if not manifest.rounds:
        folded = manifest.leaves.sparkSession.createDataFrame([], schema)
    else:
        parents = manifest.rounds[0].unionByName(_as_parents(block_paths(manifest)))

        def fold(rows: pa.Table, parents: pa.Table) -> pa.Table:
            block = _Block(parents)
            above = np.frombuffer(block.above, STEP)
            places = rows.column("pos").to_numpy() % width
            digests = sha256.from_bytes(_joined(rows.column("claimed")))
            roots = fold_block(digests, block.steps(places), above)
            return pa.table(
                {
                    "tree": rows.column("tree"), "leaf": rows.column("leaf"),
                    "proof": pa.array(_proofs(block, places, above), pa.binary()), "folded": _binary(roots),
                    **{f"_k{i}": rows.column(f"_k{i}") for i in range(len(keep))},
                }
            )

        folded = (
            claims.groupBy("tree", "block").cogroup(parents.groupBy("tree", "block")).applyInArrow(fold, schema)
        )
    tops = manifest.subroots.select("tree", F.col("digest").alias("subroot"))
    root = manifest.root.select(F.col("digest").alias("root"))
    tops = F.broadcast(root).crossJoin(tops)
    text = lambda c: F.lower(F.hex(c))
    return folded.join(tops, "tree").select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        text("proof").alias("proof_sha256"), text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def verify_documents(
    docs: DataFrame, tampered: Column, tampered_text: Column, block_levels: int = BLOCK_LEVELS
) -> DataFrame:
    """The manifest of ``documents`` and, for every row, the root that follows from a tampered text.

    A leaf is doc_id, source, lang, n_chars and text.  Where ``tampered`` holds, the leaf is claimed to be
    the one with ``tampered_text``.  A null ``tampered`` is false.  Nulls are fields of their own; texts
    are hashed whole.
    """
    kinds = dict(docs.dtypes)
    fields = [(F.col(c), kinds[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaf = leaf_digest(fields)
    other = leaf_digest([*fields[:-1], (tampered_text, "string")])
    rows = docs.select("doc_id", "source", leaf.alias("digest"), F.when(tampered, other).alias("claimed"))
    rows = shared(rows.withColumn("claimed", F.coalesce("claimed", "digest")), "digests")
    manifest = build_manifest(rows, "source", ["doc_id"], block_levels=block_levels)
    return fold_claims(manifest, "claimed", ["doc_id"])

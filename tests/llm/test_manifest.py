"""The Merkle manifest against a plain tree, over small rows and over the smallest test table."""

import hashlib
import os
import zlib

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sheafwork.llm import manifest, queries, sha256
from sheafwork.llm.tables import importable_on_workers

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree int, pos string, digest string"


def joined(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    values = [row[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return joined(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([joined(*last[k : k + 3]) for k in range(0, len(last), 3)])
    return levels


def plain(rows):
    """The expected rows, by building and folding whole trees."""
    groups = {}
    for row in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        groups.setdefault(row["source"], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    found = []
    for place, source in enumerate(order):
        for k, row in enumerate(groups[source]):
            other, siblings = dict(row), []
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                other["text"] = row["text"] and row["text"].replace("\n", "")
            folded = leaf(other)
            for levels, at in ((trees[source], k), (top, place)):
                for level in levels[:-1]:
                    run = level[at // 3 * 3 : at // 3 * 3 + 3]
                    siblings += run[: at % 3] + run[at % 3 + 1 :]
                    run[at % 3] = folded
                    folded, at = joined(*run), at // 3
            root = top[-1][0]
            found.append((row["doc_id"], leaf(row), trees[source][-1][0], root, joined(*siblings), folded, folded == root))
    return sorted(found, key=repr)


def verified(docs, **options):
    lines = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    found = manifest.verify_documents(docs, odd == 0, lines, **options)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.collect()), key=repr)


def test_states_resume_like_hashlib():
    digests = [hashlib.sha256(os.urandom(5)).digest() for _ in range(6)]
    words = sha256.from_bytes(b"".join(digests))
    assert sha256.to_bytes(words) == b"".join(digests)
    state = sha256.compress(sha256.fresh(3), sha256.hex_block(words[:, :3]))
    kept = sha256.from_bytes(sha256.to_bytes(state))
    made = sha256.finish(sha256.compress(kept, sha256.hex_block(words[:, 3:])), np.full(3, 2))
    expected = [hashlib.sha256((a.hex() + b.hex()).encode()).digest() for a, b in zip(digests, digests[3:])]
    assert sha256.to_bytes(made) == b"".join(expected)


@pytest.mark.parametrize("block_levels", [1, 2, 7])
def test_manifest_equals_plain_tree(spark, block_levels):
    importable_on_workers(spark)
    rows = [(k, f"text\n{k}\nä", "en", f"s{k % 3}", 9, 1, "x", "y") for k in range(40)]
    rows += [(100 + k, "a\nb", None, "é", None, None, None, None) for k in range(2)]
    rows += [(200, None, "en", None, 0, 1, "", ""), (201, "", "", None, 0, 1, "", ""), (202, "\n" * 70_000, "", "", 1, 1, "", "")]
    rows += [rows[4], rows[4], (4, "other\n", "en", "s1", 3, 1, "", ""), (None, "n\n", "en", "s1", 3, 1, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    names = SCHEMA.replace(",", "").split()[::2]
    assert verified(docs, block_levels=block_levels) == plain([dict(zip(names, r)) for r in rows])


def test_no_rows_and_one_row(spark):
    importable_on_workers(spark)
    assert verified(spark.createDataFrame([], SCHEMA)) == []
    row = (7, "a\n", "en", "s", 2, None, None, None)
    assert verified(spark.createDataFrame([row], SCHEMA)) == plain([dict(zip(SCHEMA.replace(",", "").split()[::2], row))])


def test_only_the_tree_states_are_read_to_the_left(spark):
    """A fold with a wrong sibling on the left still gives the right root; on the right it does not."""
    rng = np.random.default_rng(3)
    nodes = rng.integers(0, 1 << 32, (8, 3), dtype=np.uint64).astype(np.uint32)
    top, states, children, size = manifest._level(nodes)
    wrong = np.ascontiguousarray(children.transpose(2, 1, 0))
    wrong[:, 0] += 1
    again = manifest._resume(nodes[:, 1:2], states[:, 1], np.array([1]), size, wrong)
    assert (again == top).all()
    wrong[:, 2] += 1
    assert (manifest._resume(nodes[:, 1:2], states[:, 1], np.array([1]), size, wrong) != top).any()


def test_query_equals_plain_tree(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = queries.QUERIES["op11_midstate_manifest"](spark, SMALL)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows)

"""op2's likeness and op5's code lengths against plain versions of their rules."""

import random
from collections import Counter, defaultdict
from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafwork.llm import imatch, language
from sheafwork.llm.tables import importable_on_workers


def plain_print(hashes, hash_of):
    """The plain rule: sets of terms by the zero bits of each draw."""
    parts = [sorted(hashes)]
    for draw in range(imatch.DRAWS):
        for zeros in imatch.ZEROS:
            parts.append(sorted(t for t in hashes if (t >> 8 * draw) % (1 << zeros) == 0))
    return [hash_of(part) for part in parts]


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    best = 0.0
    for step in range(len(imatch.ZEROS)):
        pairs = list(zip(a[1 + step :: len(imatch.ZEROS)], b[1 + step :: len(imatch.ZEROS)]))
        held = [p == q for p, q in pairs if p or q]
        if 2 * len(held) >= imatch.DRAWS:
            best = max(best, sum(held) / len(held))
    return best


def test_likeness_is_the_plain_one(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = [" ".join(rng.sample(words, n)) for n in (1, 2, 5, 9, 40, 40, 300, 2500)] + ["", "? !"]
    rows += [rows[6] + " w1 w2", " ".join(rows[6].split()[:200] + rows[7].split()[:100]), rows[7].replace("w10 ", "")]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string")
    every = lambda t: F.lit(True)
    got = texts.select(
        "i", imatch.terms(F.col("text")).alias("terms"), imatch.fingerprint(F.col("text"), every).alias("print")
    ).cache()
    found = {r.i: r for r in got.collect()}
    # A hash stands for one set of terms, and 0 for none of them.
    sets = defaultdict(set)
    for r in found.values():
        plain = plain_print(r.terms, tuple)
        assert len(plain) == len(r.print) == 1 + imatch.DRAWS * len(imatch.ZEROS)
        for value, part in zip(r.print, plain):
            sets[value].add(part)
    assert all(len(s) == 1 for s in sets.values()) and sets[0] == {()}
    assert len(sets) == len(set().union(*sets.values()))
    pairs = got.select("i", F.col("print").alias("p")).crossJoin(got.select(F.col("i").alias("j"), F.col("print").alias("q")))
    for r in pairs.select("i", "j", imatch.likeness(F.col("p"), F.col("q")).alias("n")).collect():
        assert r.n == pytest.approx(plain_likeness(found[r.i]["print"], found[r.j]["print"]))
        assert r.i != r.j or r.n == 1
    alike = {(r.i, r.j): r.n for r in pairs.select("i", "j", imatch.likeness(F.col("p"), F.col("q")).alias("n")).collect()}
    assert alike[6, 10] > 0.7 and alike[6, 11] > 0.2 and alike[4, 5] < 0.2 and alike[8, 9] == 1


def plain_bits(counts, context, byte):
    """PPM with escape method C, by its recursive rule."""
    if context is None:
        return 8.0
    after = counts[context]
    total, distinct = sum(after.values()), len(after)
    if byte in after:
        return -log2(after[byte] / (total + distinct))
    shorter = plain_bits(counts, context[1:] if context else None, byte)
    return shorter - (log2(distinct / (total + distinct)) if total else 0.0)


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_code_lengths_are_the_plain_ones(spark, monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK_BYTES", block)
    importable_on_workers(spark)
    rng = random.Random(5)
    learned = {
        "aa": ["the cat sat\n", "a", "", "on the mat then", "\x00\x00\x00"],
        "bb": ["дом и сад", "кот", "的的 в саду"],
        "cc": ["".join(chr(rng.randrange(32, 0x2000)) for _ in range(400))],
    }
    rows = [(i, t, lang) for lang, ts in learned.items() for i, t in enumerate(ts)]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"]
    asked = ["the dom", "сад и кот", "", "x", "zq" * 40, "\x00\x00\x00\x00", learned["cc"][0] + "cat", "\U0001f600 the"]
    data = [t.encode() for t in asked]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    got = model.lengths(np.frombuffer(b"".join(data), np.uint8), offsets)
    for k, lang in enumerate(model.languages):
        counts = defaultdict(Counter)
        for text in learned[lang]:
            padded = b"\n\n\n" + text.encode()
            for i in range(3, len(padded)):
                for order in range(4):
                    counts[padded[i - order : i]][padded[i]] += 1
        for j, text in enumerate(data):
            padded = b"\n\n\n" + text
            plain = sum(plain_bits(counts, padded[i - 3 : i], padded[i]) for i in range(3, len(padded)))
            assert got[j, k] == pytest.approx(plain, rel=1e-5, abs=1e-4)


def test_gram_table_finds_all_keys_and_no_other():
    rng = np.random.default_rng(2)
    keys = np.unique(np.concatenate((rng.integers(0, 1 << 32, 50_000), np.arange(3000), [0, (1 << 32) - 1])))
    table = language.GramTable(keys)
    assert np.array_equal(table.find(keys.astype(np.uint32)), np.arange(len(keys)))
    others = np.setdiff1d(rng.integers(0, 1 << 32, 50_000), keys).astype(np.uint32)
    assert (table.find(others) == -1).all()
    assert (language.GramTable(np.empty(0, np.int64)).find(others) == -1).all()

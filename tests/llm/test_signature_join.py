"""MinHash near duplicates against comparing all sets."""

import re

import numpy as np
import pytest
from conftest import SMALL

from sheafwork.llm import minhash, queries
from sheafwork.llm.tables import importable_on_workers

SCHEMA = "doc_id bigint, text string, n string, fp string, sig string, component_id string"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs of different sets."""
    sets = [shingles(t) for _, t in rows]
    distinct = [s for s in dict.fromkeys(sets) if s]
    root = list(range(len(distinct)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(distinct):
        for j in range(i):
            if 100 * len(a & distinct[j]) >= 85 * len(a | distinct[j]):
                root[top(i)] = top(j)
    where = {s: top(k) for k, s in enumerate(distinct)}
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[where[s]] = min(i, least.get(where[s], i))
    out = []
    for (i, _), s in zip(rows, sets):
        component = least.get(where[s]) if s else i
        out.append((i, len(s), component, component == i))
    return sorted(out, key=repr)


def found(docs, **options):
    result = minhash.near_duplicates(docs, **options)
    assert result.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, result.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    """Edits of one text, from light to heavy, chains of edits, a common line, edges, copies and long texts."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(5000)]

    def fresh(size):
        return rng.choice(words, size).tolist()

    def edited(text, edits):
        text = list(text)
        for at in rng.integers(0, len(text), edits):
            text[at] = str(rng.choice(words))
        return text

    base, line = fresh(150), fresh(40)
    texts = [base] + [edited(base, k % 7) for k in range(80)]
    for _ in range(6):
        text = fresh(90)
        for _ in range(5):
            texts.append(text)
            text = edited(text, 1)
    texts += [line + fresh(int(k)) for k in rng.integers(1, 40, 60)]
    made = [" ".join(t) for t in texts] + ["", None, " \n", "one two", "One  two", "one two three", "é b c d e f", "É b c d e f"]
    long = fresh(30_000)
    made += [" ".join(long), "\t".join(edited(long, 300)), "word " * 9000, "word " * 12]
    made = list(enumerate(made))
    return made + [made[3], (None, made[5][1]), (None, "alone without an id"), (4, "another text of four")]


def table(spark, rows):
    importable_on_workers(spark)
    return spark.createDataFrame([(*r, "a", "b", None, "d") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("paired, block", [(minhash.PAIRED, minhash.BLOCK), (1, 20), (1000, 20)])
def test_components_equal_brute_force(spark, rows, monkeypatch, paired, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    assert found(table(spark, rows), paired=paired) == plain(rows)


def test_no_rows(spark):
    assert found(table(spark, [])) == []
    assert found(table(spark, [(1, None), (None, "")])) == plain([(1, None), (None, "")])


def test_agreements_follow_the_index():
    """Pairs of an index of 0.85 agree in 0.85 of the coordinates, and none in fewer than is asked for."""
    rng = np.random.default_rng(1)
    agreed = []
    for _ in range(300):
        values = rng.integers(0, 1 << 63, 215, dtype=np.uint64)
        a, b = np.sort(values[:200]), np.sort(values[15:])
        index = 185 / 215
        agreed.append(int((minhash.signature(a) == minhash.signature(b)).sum()))
    assert abs(np.mean(agreed) / minhash.COORDINATES - index) < 0.01
    assert min(agreed) > minhash.MATCHES


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    result = queries.QUERIES["op12_signature_join"](spark, SMALL)
    assert sorted(map(tuple, result.collect()), key=repr) == plain(rows)

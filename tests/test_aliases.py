"""Chains of names: their ends, faults and rounds, and the files they make one."""

import math

import pytest

from sheafwork.operators import aliases, scale, selection
from sheafwork.sources.tables import table_catalog


def resolved(spark, pairs):
    df = spark.createDataFrame(pairs, "name string, points string, alias int")
    return {r.alias: (r.target, r.hops, r.error) for r in aliases.resolve_aliases(df, "name", "points").collect()}


def pairs_of(*pairs):
    return [(a, b, 0) for a, b in pairs]


@pytest.mark.parametrize("broadcast", [True, False])
def test_ends_and_faults(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(scale, "HEAVY_ROWS", 2)
    rows = pairs_of(
        ("a", "b"), ("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "y"), ("s", "s"), ("t", "s"),
        ("p", "q"), ("p", "r"), ("to p", "p"), ("n", None), ("to n", "n"), (None, "a"), ("m", None), ("m", "c"), ("", "é"),
    ) + [(f"hot{i}", "b", 0) for i in range(9)]
    cycle, none = (None, None, aliases.CYCLE), (None, None, aliases.NO_TARGET)
    conflict = (None, None, aliases.CONFLICT)
    expected = {"a": ("c", 2, None), "b": ("c", 1, None), "m": ("c", 1, None), "": ("é", 1, None)}
    expected |= dict.fromkeys(["x", "y", "z", "s", "t"], cycle) | {"p": conflict, "to p": conflict, "n": none, "to n": none}
    expected |= {f"hot{i}": ("c", 2, None) for i in range(9)}
    assert resolved(spark, rows) == expected
    assert resolved(spark, []) == {}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    written = []
    real = aliases.materialize
    monkeypatch.setattr(aliases, "materialize", lambda *a, **k: written.append(1) or real(*a, **k))
    ends = resolved(spark, pairs_of(*[(f"n{i}", f"n{i + 1}") for i in range(1000)]))
    assert ends == {f"n{i}": ("n1000", 1000 - i, None) for i in range(1000)}
    assert len(written) <= 2 + math.ceil(math.log2(1000))


def test_aliases_are_one_file(spark):
    files = [("a.md", "A"), ("b.md", "A"), ("c/./d.md", "C"), ("e.md", "C"), ("loop", "L"), ("f.md", None)]
    catalog = table_catalog(spark.createDataFrame(files, "path string, content string"), "path", "content")
    links = spark.createDataFrame(
        [("b.md", "a.md"), ("e.md", "c/./d.md"), ("loop", "loop")], "alias string, target string"
    )
    known = aliases.with_aliases(catalog, aliases.resolve_aliases(links))
    rows = {r.path: r for r in known.collect()}
    assert known.columns == catalog.columns and len(rows) == len(files)
    assert rows["b.md"].canonical_key == "a.md" and rows["e.md"].canonical_key == rows["c/./d.md"].canonical_key
    assert (rows["loop"].content, rows["loop"].read_error) == (None, aliases.CYCLE)
    assert rows["f.md"].canonical_key == "f.md" and rows["f.md"].read_error is None
    chosen = known.selectExpr("1 AS request_id", "0 AS input_ord", "path", "canonical_key")
    assert sorted(r.path for r in selection.keep_first(chosen).collect()) == ["a.md", "c/./d.md", "f.md", "loop"]

import os

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from sheafwork import assemble, request_batch, write_bundles
from sheafwork.operators import bundles, cascade
from sheafwork.operators.scale import balanced_join, running_totals
from sheafwork.session import intermediate_dir

FILES = {
    "a/one.rs": "fn one() {\n    1\n}\n",
    "a/two.py": "def two():\n    return 2",
    "a/b/three.txt": "three  \n\n",
    "c.md": "```\nfence\n```",
}
ONE = "a/one.rs\n```rs\nfn one() {\n    1\n}\n```\n\n"
TWO = "a/two.py\n```py\ndef two():\n    return 2\n```\n\n"
THREE = "a/b/three.txt\n```txt\nthree\n```\n\n"
MD = "c.md\n```md\n```\nfence\n```\n```\n\n"


def joined(parts):
    ordered = parts.orderBy("request_id", "part_no").collect()
    found = {}
    for row in ordered:
        found[row.request_id] = found.get(row.request_id, "") + row.markdown
    return found


@pytest.mark.parametrize("large", [False, True])
def test_content_bundles(request, large, catalog_of, requests_of):
    if large:
        request.getfixturevalue("no_broadcast")
    requests = requests_of(["a/two.py", "a", "c.md"], ["a"], ["a", "nope"], ["c.md"])
    made = assemble(requests, catalog_of(FILES))
    for part_bytes, n_parts in ((1, 8), (40, 6), (1 << 20, 3)):
        parts = made.parts(part_bytes)
        assert joined(parts) == {1: TWO + THREE + ONE + MD, 2: THREE + ONE + TWO, 4: MD}
        assert parts.count() == n_parts
        if large:
            break
    assert rows_of(made.totals()) == [
        (1, 4, 10, "lines", "4 files, 10 lines"),
        (2, 3, 7, "lines", "3 files, 7 lines"),
        (4, 1, 3, "lines", "1 file, 3 lines"),
    ]
    assert rows_of(made.manifest().filter("request_id = 1"), "seq", "label", "metric", "unit") == [
        (1, "a/two.py", 2, "lines"), (2, "a/b/three.txt", 2, "lines"),
        (3, "a/one.rs", 3, "lines"), (4, "c.md", 3, "lines"),
    ]
    assert [r.request_id for r in made.report().select("request_id").distinct().collect()] == [3]
    assert rows_of(made.outcome_counts().filter("request_id = 3")) == [(3, 1, 0, 0, 1, 0)]


def test_outline_bundles(catalog_of, requests_of):
    made = assemble(requests_of(["a/one.rs", "a/two.py"], ["c.md"]), catalog_of(FILES), max_depth=0)
    markdown = joined(made.parts())
    assert markdown[1] == (
        "a/one.rs\n```\nfn one ( ) { }\n```\n\na/two.py\n```\ndef two():\n```\n\n"
    )
    assert markdown[2].startswith("c.md\n```\n---\n-- ERROR: Could not extract symbols from \"c.md\"")
    size = len(markdown[1].encode())
    assert rows_of(made.totals().filter("request_id = 1")) == [
        (1, 2, size, "characters", f"2 files, {size} characters")
    ]
    assert rows_of(made.manifest().filter("request_id = 1"), "seq", "label", "metric") == [
        (1, "a/one.rs (skeleton only; depth=0)", 14), (2, "a/two.py (skeleton only; depth=0)", 10),
    ]


def test_read_errors_stand_in_for_content(spark, requests_of):
    from sheafwork import table_catalog

    df = spark.createDataFrame([('a"b.rs', None, "denied")], "p string, c string, e string")
    catalog = table_catalog(df, "p", "c", read_error="e")
    error = 'Error: Could not read file content for "a\\"b.rs".\nDetails: denied'
    made = assemble(requests_of(['a"b.rs']), catalog)
    assert joined(made.parts())[1] == f'a"b.rs\n```rs\n{error}\n```\n\n'
    assert rows_of(bundles.content_or_error(catalog, 2)) == [('a"b.rs', "", error)]


def test_request_batch(spark):
    df = spark.createDataFrame([(7, ["b", "a", "b", None]), (8, []), (9, None)], "r int, i array<string>")
    found = sorted(map(tuple, request_batch(df, "r", "i").collect()))
    assert found == [(7, 0, "b"), (7, 1, "a"), (7, 2, "b"), (7, 3, None), (8, 0, None), (9, 0, None)]


def test_every_request_has_a_status_and_a_report(spark, catalog_of):
    df = spark.createDataFrame([(1, ["a.rs", None]), (2, []), (3, None), (4, ["a.rs"])], "r int, i array<string>")
    made = assemble(request_batch(df, "r", "i"), catalog_of({"a.rs": "x"}))
    missing = cascade.MISSING_INPUT
    assert rows_of(made.status(), "request_id", "input_ord", "status") == [
        (1, 0, "Success"), (1, 1, missing), (2, 0, missing), (3, 0, missing), (4, 0, "Success"),
    ]
    assert rows_of(cascade.request_gate(made.status())) == [(1, False), (2, False), (3, False), (4, True)]
    assert rows_of(made.outcome_counts(), "request_id", "n_success", "n_missing_input") == [
        (1, 1, 1), (2, 0, 1), (3, 0, 1), (4, 1, 0),
    ]
    assert list(joined(made.parts())) == [4]
    lines = made.report().orderBy("request_id", "section_no", "input_ord", "line_no").collect()
    texts = {k: [r.text for r in lines if r.request_id == k] for k in (1, 2, 3, 4)}
    assert texts[1][1:-1] == ["  • Input number 2", '  ✓ "a.rs"']
    assert texts[2] == texts[3] and texts[2][1:-1] == ["  • Input number 1"] and texts[4] == []


def test_repeated_paths_are_refused(spark):
    from sheafwork import table_catalog

    df = spark.createDataFrame([("a", "1"), ("a", "2")], "p string, c string")
    with pytest.raises(ValueError, match="'a' occurs 2 times"):
        table_catalog(df, "p", "c")
    assert table_catalog(df, "p", "c", check_unique=False).count() == 2


def test_write_bundles(spark, tmp_path, catalog_of, requests_of):
    parts = assemble(requests_of(["a", "c.md"], ["c.md"]), catalog_of(FILES)).parts(30)
    for fmt in ("parquet", "json"):
        write_bundles(parts, str(tmp_path / fmt), fmt)
        back = spark.read.schema(parts.schema).format(fmt).load(str(tmp_path / fmt))
        assert rows_of(back, *parts.columns) == rows_of(parts)
    write_bundles(parts, str(tmp_path / "text"), "text")
    for request_id, markdown in joined(parts).items():
        files = sorted((tmp_path / "text" / f"request_id={request_id}").glob("part-*"))
        assert "".join(f.read_text() for f in files) == markdown
    with pytest.raises(ValueError, match="not one of"):
        write_bundles(parts, str(tmp_path / "csv"), "csv")


def test_running_totals_cut_a_large_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") < 4500, "hot").otherwise(F.col("id").cast("string")).alias("g"),
        F.hash("id").alias("o"), "id", (F.col("id") % 7).alias("w"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = running_totals(df, ["g"], [F.col("o"), F.col("id")], {"n": F.lit(1), "s": F.col("w")})
        found = {r.id: (r.n, r.s) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    expected, totals = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r.o, r.id)):
        n, s = totals.get(r.g, (0, 0))
        expected[r.id] = (n, s)
        totals[r.g] = (n + 1, s + r.w)
    assert found == expected


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_balanced_join_equals_a_plain_join(spark, no_broadcast, how):
    left = spark.range(200).select((F.col("id") % F.lit(9)).alias("k"), F.col("id").alias("l"))
    left = left.unionByName(spark.range(300).select(F.lit(1).alias("k"), (F.col("id") + 1000).alias("l")))
    right = spark.range(40).select((F.col("id") % F.lit(6)).alias("k"), F.col("id").alias("r"))
    for split in ("both", "left"):
        found = balanced_join(left, right, ["k"], how, split=split)
        plain = left.join(right, ["k"], how)
        assert found.columns == plain.columns
        assert found.exceptAll(plain).count() == 0
        assert plain.exceptAll(found).count() == 0


def test_content_is_not_read_while_resolving(spark, tmp_path, catalog_of, requests_of):
    from sheafwork.operators import matching

    catalog_of(FILES).write.parquet(str(tmp_path / "c"))
    catalog = spark.read.parquet(str(tmp_path / "c"))
    inputs = requests_of(["a", "c.md", "tw", "*.md"]).select("input")
    for match in (
        matching.match_direct, matching.match_directory, matching.match_glob, matching.match_substring,
    ):
        plan = match(inputs, catalog)._jdf.queryExecution().executedPlan().toString()
        assert "content:string" not in plan
        assert "CartesianProduct" not in plan
        assert "NestedLoop" not in plan


def test_measures(catalog_of):
    found = bundles.measure(bundles.content_or_error(catalog_of(FILES)))
    block_bytes = dict(rows_of(found, "path", "block_bytes"))
    assert block_bytes["a/one.rs"] == len(ONE)
    assert block_bytes["a/b/three.txt"] == len(THREE)


def test_filter_by_hash_keeps_all_that_is_wanted_and_moves_no_content(spark):
    from pyspark.sql import functions as F

    from sheafwork.operators.scale import possibly_in

    df = spark.range(200_000).select(F.format_string("d/%d.txt", "id").alias("path"), "id")
    wanted = df.filter("id % 7 = 0").select("path")
    passed = possibly_in(df, wanted, "path")
    assert passed.columns == df.columns
    counts = passed.agg(F.count_if(F.col("id") % 7 == 0), F.count("*")).first()
    assert counts[0] == wanted.count()
    assert counts[1] < counts[0] * 1.01
    assert possibly_in(df, wanted.limit(0), "path").count() == 0


def test_chosen_content_is_filtered_before_the_shuffle(spark, catalog_of, no_broadcast):
    from sheafwork.operators import bundles, cascade

    catalog = catalog_of({f"d/{i}.txt": "x" for i in range(9)})
    kept = bundles.only_chosen(catalog, catalog.select("path").filter("path = 'd/3.txt'"))
    assert [row.path for row in kept.collect()] == ["d/3.txt"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("large", [False, True])
def test_blocks_are_sent_once_to_a_task(request, large, spark, tmp_path, catalog_of, requests_of):
    """Requests with the same files share what is shuffled; parts are neither shuffled nor written again."""
    if large:
        request.getfixturevalue("no_broadcast")
    files = {f"{d}/{n:03d}.txt": f"{d} {n}\n" * 20 for d in "ab" for n in range(150)}
    made = assemble(requests_of(["a", "b"], ["b", "a"], ["a/001.txt"], ["b", "a", "b/007.txt"]), catalog_of(files))
    sent, real = [], bundles.materialize
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bundles, "materialize", lambda df, label, **k: sent.append(real(df, label, **k)) or sent[-1])
        parts = made.parts(2000)
    (rows,) = sent
    assert rows.select(F.sum(F.size("places"))).first()[0] == 901
    assert rows.count() < 901 / 2
    assert "hashpartitioning(request_id" not in parts._jdf.queryExecution().executedPlan().toString()
    one = "".join(f"{p}\n```txt\n{t.rstrip()}\n```\n\n" for p, t in files.items())
    at = one.index("b/000.txt")
    only = "a/001.txt\n```txt\n" + files["a/001.txt"].rstrip() + "\n```\n\n"
    assert joined(parts) == {1: one, 2: one[at:] + one[:at], 3: only, 4: one[at:] + one[:at]}
    before = set(os.listdir(intermediate_dir(spark)))
    write_bundles(parts, str(tmp_path / "out"))
    assert not [n for n in set(os.listdir(intermediate_dir(spark))) - before if n.startswith("parts-")]
    back = spark.read.schema(parts.schema).parquet(str(tmp_path / "out"))
    assert rows_of(back, *parts.columns) == rows_of(parts)

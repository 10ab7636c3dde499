import random
import re
import time

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from sheafwork.functions import text as texts
from sheafwork.operators import outlines as o

RUST = """
/// Adds { one.
fn add<'a>(x: &'a str, c: char) -> Vec<u8> {
    let open = "{[( \\" ";  // not } here
    if c == '{' { call(x); }
}
struct Point { x: f64 }
"""


def outline(spark, text, run, level):
    df = spark.createDataFrame([(1, text)], "id bigint, text string")
    return run(df, level).first().outline


def braces(df, level):
    return o.outline_brackets(df, "id", "text", level, o.BRACES)


def test_brackets_in_strings_comments_and_characters_do_not_count(spark):
    assert outline(spark, RUST, braces, 0) == (
        "/// Adds { one. fn add < 'a > ( ) -> Vec < u8 > { } struct Point { }"
    )
    assert outline(spark, RUST, braces, 1) == (
        "/// Adds { one. fn add < 'a > ( x : & 'a str , c : char ) -> Vec < u8 > { "
        'let open = "{[( \\" " ; // not } here if c == \'{\' { } } struct Point { x : f64 }'
    )


def test_script_strings(spark):
    code = "const f = (a) => { return `}${a}` + '{' + \"(\" } /* ) */"

    def script(df, level):
        return o.outline_brackets(df, "id", "text", level, o.SCRIPT)

    assert outline(spark, code, script, 0) == "const f = ( ) => { } /* ) */"
    assert outline(spark, code, script, 1) == (
        "const f = ( a ) => { return `}${a}` + '{' + \"(\" } /* ) */"
    )


def test_json(spark):
    text = '{"a": [1.5, {"b}": null}], "c": -2}'

    def data(df, level):
        return o.outline_brackets(df, "id", "text", level)

    assert outline(spark, text, data, 0) == "{ }"
    assert outline(spark, text, data, 1) == '{ "a" : [ ] , "c" : - 2 }'
    assert outline(spark, text, data, 9) == '{ "a" : [ 1.5 , { "b}" : null } ] , "c" : - 2 }'


def test_long_strings_with_many_escapes(spark):
    text = '{"a": "' + '\\"' * 200_000 + '"}'

    def data(df, level):
        return o.outline_brackets(df, "id", "text", level)

    assert len(outline(spark, text, data, 1)) == len(text) + 3


PAGE = (
    "<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a='</p>';</script>"
    "<style>p > b {}</style></head><body> top <!-- <div> --> <p>one<br>two<p>three "
    "<div>inner <b>bold</b> after</div><img src='x'/> end</body></html>"
)


def markup(df, level):
    return o.outline_markup(df, "id", "text", level)


def test_markup(spark):
    assert outline(spark, PAGE, markup, 1) == "(No structure found)"
    assert outline(spark, PAGE, markup, 2) == "top one two three end"
    assert outline(spark, PAGE, markup, 3) == "T &amp; t top one two three inner after end"
    assert outline(spark, PAGE, markup, 9) == (
        "T &amp; t top one two three inner bold after end"
    )


def test_a_deeper_limit_never_loses_a_token(spark):
    for run, text in ((markup, PAGE), (braces, RUST)):
        tokens = [outline(spark, text, run, n).split(" ") for n in range(5)]
        tokens = [[] if t == texts.NO_STRUCTURE.split(" ") else t for t in tokens]
        for less, more in zip(tokens, tokens[1:], strict=False):
            rest = iter(more)
            assert all(token in rest for token in less)


@pytest.mark.parametrize("text", ["", "   \n\t　 ", None])
def test_documents_without_tokens_keep_a_row(spark, text):
    for run in (markup, braces):
        assert outline(spark, text, run, 3) == texts.NO_STRUCTURE


def test_nesting_depth_of_broken_markup(spark):
    df = spark.createDataFrame([(1, "</b>x<i>y")], "id bigint, text string")
    from pyspark.sql import functions as F

    nodes = o.nesting_depth(o.tokenize(df, "id", "text", F.lit(o.MARKUP)))
    assert rows_of(nodes, "ord", "depth", "is_leaf", "tok") == [
        (0, -1, False, "</b>"), (1, 0, True, "x"), (2, 0, False, "<i>"), (3, 1, True, "y"),
    ]


def test_quoted_values_and_bare_signs(spark):
    page = "<i title='a > b'>1 < 2 and <3</i><a href=x>y</a> <"
    assert outline(spark, page, markup, 1) == "1 < 2 and <3 y <"
    assert outline(spark, "a <!-- b <i>c", markup, 1) == "a"
    assert outline(spark, "a <b title='c", markup, 1) == "a"


@pytest.mark.parametrize("piece", ["<!--a", "<script>", "<script ", "<", "<a ", "<a b='", "/*", '"\\"', "`\\"])
def test_a_megabyte_of_what_is_never_closed_ends(spark, piece):
    text = piece * (1_000_000 // len(piece))

    def script(df, level):
        return o.outline_brackets(df, "id", "text", level, o.SCRIPT)

    start = time.monotonic()
    outline(spark, text, script if piece[0] in '/"`' else markup, 3)
    assert time.monotonic() - start < 20


CODE = "import a\n\nclass B:\n    def c(self):\n        if x:\n            pass\n    d = 1\n"


def test_indent(spark):
    def indent(df, level):
        return o.outline_indent(df, "id", "text", level)

    assert outline(spark, CODE, indent, 0) == "import a class B:"
    assert outline(spark, CODE, indent, 1) == "import a class B: def c(self): d = 1"
    assert outline(spark, CODE, indent, 9) == re.sub(r"\s*\n\s*", " ", CODE.strip())
    assert outline(spark, CODE.replace("    ", "\t"), indent, 1) == (
        "import a class B: def c(self): d = 1"
    )
    assert outline(spark, "a\nb", indent, 0) == "a b"
    assert outline(spark, " \n", indent, 0) == texts.NO_STRUCTURE


def levels_of(widths):
    """The plain rule: a stack of the indents around a line."""
    stack, levels = [0], []
    for width in widths:
        while stack and stack[-1] >= width:
            stack.pop()
        levels.append(len(stack))
        stack.append(width)
    return levels


def test_indent_levels_are_those_of_a_stack(spark):
    rng = random.Random(7)
    rows = [[0, 2, 6, 7], [0, 4, 2, 4, 0, 1], [3, 3, 5], [], [0] * 600, list(range(700)), list(range(700, 0, -1))]
    rows += [[rng.randrange(9) for _ in range(n)] for n in (1, 255, 256, 257, 2000)]
    assert levels_of(rows[0]) == [0, 1, 2, 3] and levels_of(rows[1]) == [0, 1, 1, 2, 0, 1]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, widths array<int>")
    found = {r.id: r.levels for r in df.select("id", o.indent_levels(F.col("widths")).alias("levels")).collect()}
    assert all(found[i] == levels_of(widths) for i, widths in enumerate(rows))

    def indent(df, level):
        return o.outline_indent(df, "id", "text", level)

    code = "a\n  b\n      c\n       d\n    e\n\nf\n"
    assert outline(spark, code, indent, 1) == "a b f"
    assert outline(spark, code, indent, 2) == "a b c e f"
    start = time.monotonic()
    assert len(outline(spark, "x\n  y\n" * 100_000, indent, 0)) == 199_999
    assert time.monotonic() - start < 20


def test_dispatch(catalog_of):
    catalog = catalog_of(
        {
            "a.html": "<p>x</p>", "b.htm": "<b>y</b>", "c.rs": "fn f() { g(); }", "d.ts": "f({a: 1})",
            "e.json": "[[1]]", "f.py": "a\n  b\n    c", "g.TXT": "t\n", "h": "u", "i.RS": "fn",
        }
    )
    found = dict(rows_of(o.outline_dispatch(catalog, 0)))
    banner = (
        "---\n-- ERROR: Could not extract symbols from \"g.TXT\": Language support not configured "
        "for file extension: 'TXT'\n-- Falling back to full file content.\n---\n\nt\n"
    )
    assert found.pop("g.TXT") == banner
    assert found.pop("h").endswith("extension: ''\n-- Falling back to full file content.\n---\n\nu")
    assert "extension: 'RS'" in found.pop("i.RS")
    assert found == {
        "a.html": "x", "b.htm": texts.NO_STRUCTURE, "c.rs": "fn f ( ) { }", "d.ts": "f ( )",
        "e.json": "[ ]", "f.py": "a",
    }


def test_no_text_is_shuffled(spark, catalog_of):
    df = spark.createDataFrame([(1, PAGE)], "id bigint, text string")
    for made in (markup(df, 3), braces(df, 3), o.outline_dispatch(catalog_of({"a.html": PAGE}), 3)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_rows_with_the_same_id_stay_apart(spark):
    df = spark.createDataFrame([(1, "<i>a"), (1, "<b>c"), (1, "<b>c")], "id bigint, text string")
    assert sorted(row.outline for row in markup(df, 3).collect()) == ["a", "c", "c"]


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 512, 70_001])
def test_running_sum_across_slices(spark, size):
    from itertools import accumulate

    from pyspark.sql import functions as F

    values = [(7 * i) % 5 - 2 for i in range(size)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    assert df.select(o.running_sum(F.col("v")).alias("s")).first().s == list(accumulate(values))


def test_a_megabyte_of_tags_ends(spark):
    start = time.monotonic()
    assert outline(spark, "<i>" * 200_000 + "x" + "</i>" * 100_000 + "y", markup, 100_000) == "y"
    assert time.monotonic() - start < 30


def test_levels_at_once_equal_single_levels(spark):
    rows = [(1, '{"a":[{"b":"}"},2]}'), (2, ""), (3, None), (4, "}{"), (5, "[[[[]]]]" * 300)]
    df = spark.createDataFrame(rows, "id int, text string")
    found = o.outline_levels(df, "id", "text", (0, 1, 3))
    for level in (0, 1, 3):
        single = rows_of(o.outline_brackets(df, "id", "text", level), "doc_id", "outline")
        assert rows_of(found.filter(f"max_level = {level}"), "doc_id", "outline") == single


def test_small_scans_are_spread_and_nothing_else(spark, tmp_path):
    from sheafwork.operators.scale import spread

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "small"))
    small = spark.read.parquet(str(tmp_path / "small"))
    cores = spark.sparkContext.defaultParallelism
    assert spread(small).rdd.getNumPartitions() == cores and spread(small).count() == 100
    grouped = small.groupBy("id").count()
    assert spread(grouped) is grouped
    wide = spark.range(100, numPartitions=cores)
    assert spread(wide) is wide


def test_bracketed_texts_are_dealt_by_bytes(spark, monkeypatch):
    """Rows that all lie in one of many partitions of a scan do not end in one task."""
    monkeypatch.setattr(o, "BRACKET_BYTES", 1000)
    text = F.when(F.spark_partition_id() == 0, F.lit('{"a":[1,{"b":2}]}')).alias("t")
    rows = spark.range(0, 1600, 1, 16).select("id", text).where("t is not null")
    made = o.outline_levels(rows, "id", "t", (1, 2))
    assert rows.count() == 100 and made.count() == 200
    held = made.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count("*")).first()
    assert held[0] <= 2 * 40 and held[1] >= 4
    assert {r.outline for r in made.where("max_level = 1").collect()} == {'{ "a" : [ ] }'}

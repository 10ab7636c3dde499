import pytest
from pyspark.sql import functions as F

from sheafwork.functions import globs

MATCHES = [
    ("src/**/*.ts", "src/a.ts", True),
    ("src/**/*.ts", "src/x/y/a.ts", True),
    ("src/**/*.ts", "src/a.tsx", False),
    ("src/**/*.ts", "xsrc/a.ts", False),
    ("*.rs", "a/b.rs", False),
    ("*.rs", ".rs", True),
    ("[!a]b?.py", "cbx.py", True),
    ("[!a]b?.py", "abx.py", False),
    ("[]]z", "]z", True),
    ("[!]]z", "]z", False),
    ("[!]]z", "az", True),
    ("{a,b}.rs*", "a.rs", False),
    ("{a,b}.rs*", "{a,b}.rs", True),
    ("**/x.rs", "x.rs", True),
    ("**/x.rs", "p/q/x.rs", True),
    ("**/**/x.rs", "p/x.rs", True),
    ("a/**/b/**/c*", "a/b/x/c1", True),
    ("[^x].c", "^.c", True),
    ("[^x].c", "x.c", True),
    ("[^x].c", "a.c", False),
    ("[a-c]/d", "b/d", True),
    ("[a-c]/d", "d/d", False),
    ("[z-a]x", "zx", False),
    ("[!z-a]x", "zx", True),
    ("[a-]x", "-x", True),
    ("[+-9]x", "5x", True),
    ("[+-9]x", "/x", False),
    ("[!a]x", "/x", False),
    ("a?b", "a/b", False),
    ("a?b", "aéb", True),
    ("a?b", "a😀b", True),
    ("[\\]x", "\\x", True),
    ("[\\]x", "]x", False),
    ("[&&b]", "&", True),
    ("a+(b)*", "a+(b)c", True),
    ("a.b*", "axb", False),
    ("*.txt", "a.txt\n", False),
    ("./*.rs", "b.rs", True),
    ("a//*", "a/b", True),
    ("a/./*", "a/b", True),
    ("A*", "ab", False),
    ("*", ".hidden", True),
]


@pytest.fixture(scope="module")
def results(spark):
    rows = [(i, g, p) for i, (g, p, _) in enumerate(MATCHES)]
    df = spark.createDataFrame(rows, "i int, g string, p string")
    literals = globs.glob_literals(F.col("g"))
    framed = F.concat(F.lit("/"), F.col("p"), F.lit("/"))
    out = df.select(
        "i",
        globs.glob_error(F.col("g")).alias("error"),
        F.rlike("p", globs.glob_to_regex(F.col("g"))).alias("hit"),
        F.forall(literals, lambda piece: F.contains(framed, piece)).alias("has_literals"),
    )
    return {r.i: r for r in out.collect()}


@pytest.mark.parametrize("case", range(len(MATCHES)))
def test_match(results, case):
    glob, path, expected = MATCHES[case]
    row = results[case]
    assert row.error is None
    assert row.hit is expected, (glob, path)
    if expected:
        assert row.has_literals, "a selected path must hold every literal piece"


@pytest.mark.parametrize(
    ("glob", "position", "message"),
    [
        ("a***", 3, globs.BAD_STARS),
        ("***", 2, globs.BAD_STARS),
        ("x/****/y", 4, globs.BAD_STARS),
        ("a**b", 0, globs.BAD_RECURSION),
        ("a/b**", 2, globs.BAD_RECURSION),
        ("**b", 2, globs.BAD_RECURSION),
        ("a/**b", 4, globs.BAD_RECURSION),
        ("src/[a", 4, globs.BAD_CLASS),
        ("é[", 1, globs.BAD_CLASS),
        ("[]", 0, globs.BAD_CLASS),
        ("[!]", 0, globs.BAD_CLASS),
        ("x/ab[c/d]", 2, globs.BAD_CLASS),
        ("*/[a]/[", 6, globs.BAD_CLASS),
    ],
)
def test_malformed(column, glob, position, message):
    assert column([glob], globs.glob_error) == [globs.ERROR_FORMAT % (position, message)]
    assert column([glob], globs.glob_to_regex) == [None]


@pytest.mark.parametrize("glob", ["src/**", "**", "a*/", "/a*", "a*/."])
def test_globs_that_select_no_file(column, glob):
    assert column([glob], globs.glob_error) == [None]
    assert column([glob], globs.glob_to_regex) == [None]


def test_is_glob(column):
    values = ["a", "a*", "a?", "a[", "a{", "a]", "a}", ""]
    expected = [False, True, True, True, True, False, False, False]
    assert column(values, globs.is_glob) == expected

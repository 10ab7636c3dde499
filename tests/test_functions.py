import pytest
from pyspark.sql import functions as F

from sheafwork.functions import paths, text as texts


def test_line_count(column):
    values = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb"]
    assert column(values, texts.line_count) == [0, 1, 1, 2, 1, 2]


def test_sizes(column):
    values = ["", "a", "a\n", "é", " a　\t", "😀"]
    assert column(values, texts.char_count) == [0, 1, 2, 1, 4, 1]
    assert column(values, texts.byte_count) == [0, 1, 2, 2, 6, 4]


def test_trim_end_strips_all_unicode_white_space_at_the_end_only(column):
    values = ["", "a\n\n", "\n", " a　\t", "a", "é\x85  ", "a b"]
    assert column(values, texts.trim_end) == ["", "a", "", " a", "a", "é", "a b"]


def test_white_space_is_the_unicode_property():
    assert len(texts.WHITE_SPACE) == len(set(texts.WHITE_SPACE)) == 25
    assert all(c.isspace() for c in texts.WHITE_SPACE)


def test_quoted(column):
    assert column(['a"b\\c\nd\t'], texts.quoted) == ['"a\\"b\\\\c\\nd\\t"']


def test_fence_block_keeps_inner_fences(column):
    block = column(["x\n```\ny \n"], lambda c: texts.fence_block(F.lit("a.rs"), F.lit("rs"), c))
    assert block == ["a.rs\n```rs\nx\n```\ny\n```\n\n"]


@pytest.mark.parametrize(
    ("path", "ext"),
    [
        ("a/b.rs", "rs"),
        ("a/b.tar.gz", "gz"),
        ("a/.gitignore", ""),
        ("a/Makefile", ""),
        ("a.d/file", ""),
        ("a/b.", ""),
        ("a/B.RS", "RS"),
        ("a/.x.py", "py"),
        ("a.py/", "py"),
    ],
)
def test_file_extension(column, path, ext):
    assert column([path], paths.file_extension) == [ext]


def test_display_path(column):
    values = ["/r/a/b", "/rx/a", "a"]
    assert column(values, lambda c: paths.display_path(c, F.lit("/r"))) == ["a/b", "/rx/a", "a"]
    assert column(values, lambda c: paths.display_path(c, F.lit("/r/"))) == ["a/b", "/rx/a", "a"]


def test_canonical_key(column):
    values = ["./a//b/./c/", "/a/b", "a", ".hidden/x"]
    assert column(values, paths.canonical_key) == ["a/b/c", "/a/b", "a", ".hidden/x"]


def test_url_path_and_key(column):
    values = ["https://www.h.org/a/?q#f", "http://m.h.org/a", "h.org/a/"]
    assert column(values, paths.url_path) == ["www.h.org/a/", "m.h.org/a", "h.org/a/"]
    assert column(values, lambda c: paths.url_key(paths.url_path(c))) == ["h.org/a"] * 3


def test_path_order_goes_by_component(column):
    keys = column(["a-b/x", "a/x", "a.b", "a/x/y"], paths.path_order)
    order = [p for _, p in sorted(zip(keys, ["a-b/x", "a/x", "a.b", "a/x/y"], strict=True))]
    assert order == ["a/x", "a/x/y", "a-b/x", "a.b"]


def test_ancestors(column):
    assert column(["a/b/c.txt", "c"], paths.ancestors) == [["", "a", "a/b"], [""]]


def test_lookup_path(column):
    values = ["", ".", "./a/", "a//b/.", "/a", "a/../b", "..", "a..b"]
    assert column(values, paths.lookup_path) == ["", "", "a", "a/b", None, None, None, "a..b"]

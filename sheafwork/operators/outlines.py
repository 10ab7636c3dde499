"""Depth-limited outlines of markup, bracketed and indented text.

Text is cut into tokens, each token gets a depth, tokens that are too deep are dropped, and the
rest is joined.  For markup and brackets the depth is a running sum over the document's tokens.
All of it is column functions on the document's row, so no text is shuffled, but for dealing a scan to
more tasks (``spread``), and rows with the same id stay apart.  The levels of brackets and indents are not those of a syntax tree, hence ``max_level``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sheafwork.functions import text as texts
from sheafwork.functions.binding import bind
from sheafwork.operators.scale import spread

#: Values per slice of a running sum.
SLICE = 256

#: Bracketed texts of so many bytes, with 8 a column, are outlined in one task, about.
BRACKET_BYTES = 4 << 20

MARKUP, BRACES, SCRIPT, DATA, INDENTED, UNSUPPORTED = (
    "markup", "braces", "script", "data", "indented", "unsupported",
)

#: How to outline each file extension.
KIND_OF_EXTENSION = {
    "html": MARKUP,
    "htm": MARKUP,
    "rs": BRACES,
    "ts": SCRIPT,
    "json": DATA,
    "py": INDENTED,
}

# Elements that have no closing tag, and elements whose closing tag may be left out.
VOID_ELEMENTS = "area base br col embed hr img input link meta param source track wbr".split()
OPTIONAL_CLOSE = (
    "p li dt dd option optgroup tr td th thead tbody tfoot colgroup rp rt".split()
)

# A comment, a raw element with its text, a tag, or text.  What is not closed runs to the end of the
# text, so that bad markup is read once and not again from each start; a tag does not end inside the
# quotes of a value, and a < that no name, /, ! or ? follows is text.
_IN_TAG = r"""[^>=]*+(?:=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))?+[^>=]*+)*+(?:>|\z)"""
_RAW_ELEMENT = r"(?:[Ss][Cc][Rr][Ii][Pp][Tt]|[Ss][Tt][Yy][Ll][Ee])(?![A-Za-z0-9:-])"
MARKUP_TOKEN = (
    r"<!--[\s\S]*?(?:-->|\z)"
    rf"|<{_RAW_ELEMENT}{_IN_TAG}[\s\S]*?(?:</{_RAW_ELEMENT}{_IN_TAG}|\z)"
    rf"|<[A-Za-z/!?]{_IN_TAG}"
    r"|(?:<(?![A-Za-z/!?])|[^<])[^<]*+(?:<(?![A-Za-z/!?])[^<]*+)*+"
)

_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)"
_STRING = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+(?:"|\\?\z)'
_NUMBER_OR_WORD = r"\p{N}+\.\p{N}+|[\p{L}\p{N}_$]+"
_OPERATOR = r"\.\.\.|\.\.=|\.\.|->|=>|::|&&|\|\||[=!<>]="
_OTHER = r"[^\s\p{L}\p{N}_$]"
BRACKET_TOKEN = {
    # Raw strings; one character in single quotes, which a lifetime is not.
    BRACES: "|".join(
        (
            r'r#"[\s\S]*?(?:"#|\z)', _COMMENT, _STRING, r"'(?:[^'\\\n]|\\[^\n][^'\n]*)'",
            r"'[\p{L}_][\p{L}\p{N}_]*", _NUMBER_OR_WORD, _OPERATOR, _OTHER,
        )
    ),
    SCRIPT: "|".join(
        (
            _COMMENT, _STRING, r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'",
            r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+(?:`|\\?\z)", _NUMBER_OR_WORD, _OPERATOR, _OTHER,
        )
    ),
    DATA: "|".join((_STRING, _NUMBER_OR_WORD, _OTHER)),
}


# --- tokens -------------------------------------------------------------------------------------


def _is_text(token: Column) -> Column:
    return ~F.rlike(token, F.lit(r"\A<[A-Za-z/!?]"))


def markup_delta(token: Column) -> Column:
    """+1 for a tag that opens a level, -1 for one that closes it, 0 for everything else."""

    def delta(name: Column) -> Column:
        whole = name.isin("script", "style") & ~F.startswith(token, F.lit("</"))
        level = (name != "") & ~whole & ~name.isin(*VOID_ELEMENTS, *OPTIONAL_CLOSE)
        return (
            F.when(~level | F.endswith(token, F.lit("/>")), F.lit(0))
            .when(F.startswith(token, F.lit("</")), F.lit(-1))
            .otherwise(F.lit(1))
        )

    return bind(F.lower(F.regexp_extract(token, r"\A</?([A-Za-z][A-Za-z0-9:-]*)", 1)), delta)


def bracket_delta(token: Column) -> Column:
    """+1 for an opening bracket, -1 for a closing one, 0 for everything else."""
    return (
        F.when(token.isin("{", "[", "("), F.lit(1))
        .when(token.isin("}", "]", ")"), F.lit(-1))
        .otherwise(F.lit(0))
    )


def token_array(text: Column, kind: Column) -> Column:
    """The tokens of a text; NULL for a NULL text and for a kind that has none."""
    patterns = {MARKUP: MARKUP_TOKEN, **BRACKET_TOKEN}
    return F.coalesce(
        *[
            F.when(kind == name, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
            for name, pattern in patterns.items()
        ]
    )


def running_sum(values: Column) -> Column:
    """The running sums of an array of integers.

    To append to an array copies it, so the sums are made inside slices of ``SLICE`` values, then
    over the totals of the slices.
    """

    def sums(array: Column) -> Column:
        return F.aggregate(
            array,
            F.array().cast("array<int>"),
            lambda done, value: F.array_append(
                done, F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + value
            ),
        )

    def shifted(slices: Column) -> Column:
        totals = sums(F.transform(slices, lambda part: F.element_at(part, -1)))
        return bind(
            totals,
            lambda totals: F.flatten(
                F.transform(
                    slices,
                    lambda part, i: bind(
                        F.coalesce(F.get(totals, i - 1), F.lit(0)),
                        lambda before: F.transform(part, lambda value: value + before),
                    ),
                )
            ),
        )

    def summed(values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(values), F.lit(SLICE))
        slices = F.transform(starts, lambda start: sums(F.slice(values, start, SLICE)))
        none = F.array().cast("array<int>")
        return F.when(F.size(values) > 0, bind(slices, shifted)).otherwise(none)

    return bind(values, summed)


def token_nodes(tokens: Column, kind: Column) -> Column:
    """``depth, is_leaf, tok`` of each token of an array, see ``nesting_depth``."""
    markup = kind == MARKUP

    def marked(tok: Column) -> Column:
        delta = F.when(markup, markup_delta(tok)).otherwise(bracket_delta(tok))
        leaf = F.when(markup, _is_text(tok)).otherwise(F.lit(True))
        return F.struct(tok.alias("tok"), delta.alias("delta"), leaf.alias("is_leaf"))

    def node(token: Column, level: Column) -> Column:
        depth = (
            F.when(markup & token.is_leaf, level + 1)
            .when(~markup & (token.delta == 1), level - 1)
            .otherwise(level)
        )
        return F.struct(
            depth.alias("depth"), token.is_leaf.alias("is_leaf"), token.tok.alias("tok")
        )

    def placed(tokens: Column) -> Column:
        levels = running_sum(F.transform(tokens, lambda token: token.delta))
        return F.zip_with(tokens, levels, node)

    return bind(F.transform(tokens, marked), placed)


def joined_leaves(nodes: Column, kind: Column, max_depth: int) -> Column:
    """The leaves within the limit, trimmed and joined, see ``join_tokens``."""
    limit = F.when(kind == MARKUP, F.lit(max_depth + 1)).otherwise(F.lit(max_depth))
    within = F.filter(nodes, lambda node: node.is_leaf & (node.depth <= limit))
    trimmed = F.transform(within, lambda node: texts.trim_both(node.tok))
    outline = F.array_join(F.filter(trimmed, lambda leaf: leaf != ""), " ")
    return bind(
        outline,
        lambda outline: F.when(outline != "", outline).otherwise(F.lit(texts.NO_STRUCTURE)),
    )


def tokenize(
    df: DataFrame, doc_id: str, text: str, kind: Column, task_bytes: int | None = None
) -> DataFrame:
    """``doc_id, kind, tokens``: the tokens of each document, NULL for a NULL text."""
    placed = df.select(F.col(doc_id).alias("doc_id"), kind.alias("kind"), F.col(text).alias("text"))
    placed = spread(placed, task_bytes)
    tokens = token_array(F.col("text"), F.col("kind"))
    return placed.select("doc_id", "kind", tokens.alias("tokens"))


def nesting_depth(tokens: DataFrame) -> DataFrame:
    """``doc_id, kind, ord, depth, is_leaf, tok`` of the documents of ``tokenize``.

    The document is depth 0.  A tag has the depth of its element, text is one deeper than the
    element it is in.  A bracket has the level it stands in, not the one it opens.  A document
    without any token keeps one row, with a NULL token.
    """
    nodes = token_nodes(F.col("tokens"), F.col("kind"))
    rows = tokens.select("doc_id", "kind", F.posexplode_outer(nodes).alias("ord", "node"))
    return rows.select(
        "doc_id",
        "kind",
        "ord",
        F.coalesce("node.depth", F.lit(0)).alias("depth"),
        F.coalesce("node.is_leaf", F.lit(False)).alias("is_leaf"),
        "node.tok",
    )


def join_tokens(tokens: DataFrame, max_depth: int) -> DataFrame:
    """``doc_id, outline``: the leaves within the limit, trimmed and joined by one space.

    Text leaves of markup are one deeper than their element, so they may be at
    ``max_depth + 1``.  Every document of ``tokenize`` keeps its row, also if nothing is left.
    """
    kind = F.col("kind")
    outline = joined_leaves(token_nodes(F.col("tokens"), kind), kind, max_depth)
    return tokens.select("doc_id", F.coalesce(outline, F.lit(texts.NO_STRUCTURE)).alias("outline"))


# --- outlines -----------------------------------------------------------------------------------


def outline_tokens(
    df: DataFrame, doc_id: str, text: str, kind: Column, max_depth: int, task_bytes: int | None = None
):
    return join_tokens(tokenize(df, doc_id, text, kind, task_bytes), max_depth)


def outline_markup(df: DataFrame, doc_id: str, html: str, max_depth: int) -> DataFrame:
    """Text of pages down to a nesting depth of their tags.

    Void elements and those whose closing tag may be left out open no level.  Comments and the
    text of ``script`` and ``style`` are left out.
    """
    return outline_tokens(df, doc_id, html, F.lit(MARKUP), max_depth)


def outline_brackets(
    df: DataFrame, doc_id: str, text: str, max_level: int, kind: str = DATA
) -> DataFrame:
    """Tokens of JSON or brace-language code down to a bracket level.

    Strings and comments are single tokens, so brackets inside them do not count.
    """
    if kind not in BRACKET_TOKEN:
        raise ValueError(f"kind {kind!r} is not one of {', '.join(BRACKET_TOKEN)}")
    return outline_tokens(df, doc_id, text, F.lit(kind), max_level, BRACKET_BYTES)


def outline_levels(
    df: DataFrame, doc_id: str, text: str, levels: Sequence[int], kind: str = DATA
) -> DataFrame:
    """``doc_id, max_level, outline`` for each of some levels, as by ``outline_brackets``.

    A text is cut into tokens and their depths are summed once for all levels.
    """
    if kind not in BRACKET_TOKEN:
        raise ValueError(f"kind {kind!r} is not one of {', '.join(BRACKET_TOKEN)}")
    tokens = tokenize(df, doc_id, text, F.lit(kind), BRACKET_BYTES)
    nodes = tokens.select("doc_id", "kind", token_nodes(F.col("tokens"), F.col("kind")).alias("nodes"))

    def outline(level: int) -> Column:
        joined = joined_leaves(F.col("nodes"), F.col("kind"), level)
        outline = F.coalesce(joined, F.lit(texts.NO_STRUCTURE)).alias("outline")
        return F.struct(F.lit(level).alias("max_level"), outline)

    rows = nodes.select("doc_id", F.explode(F.array(*map(outline, levels))).alias("row"))
    return rows.select("doc_id", "row.max_level", "row.outline")


def indent_levels(widths: Column) -> Column:
    """The level of each line of an array of indent widths, by a stack of the widths around it.

    A line is one level below the last line before it with a smaller width, so widths of 0, 2, 6 and 7
    are levels 0 to 3, and a width between two of the stack closes the larger one only.  A line with an
    indent is at level 1 at least.  The levels are appended inside slices of ``SLICE`` lines, as by
    ``running_sum``; the stack goes on from one slice to the next.
    """
    none = F.array().cast("array<int>")

    def pushed(state: Column, width: Column) -> Column:
        around = F.filter(state["stack"], lambda outer: outer < width)
        return bind(
            around,
            lambda around: F.struct(
                F.array_append(around, width).alias("stack"),
                F.array_append(state["levels"], F.size(around)).alias("levels"),
            ),
        )

    def of_slice(state: Column, part: Column) -> Column:
        start = F.struct(state["stack"].alias("stack"), none.alias("levels"))
        return bind(
            F.aggregate(part, start, pushed),
            lambda done: F.struct(
                done["stack"].alias("stack"), F.array_append(state["slices"], done["levels"]).alias("slices")
            ),
        )

    def levels(widths: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(widths), F.lit(SLICE))
        slices = F.transform(starts, lambda start: F.slice(widths, start, SLICE))
        start = F.struct(
            F.array(F.lit(0)).alias("stack"), F.array().cast("array<array<int>>").alias("slices")
        )
        found = F.aggregate(slices, start, of_slice, lambda state: F.flatten(state["slices"]))
        return F.when(F.size(widths) > 0, found).otherwise(none)

    return bind(widths, levels)


def indent_outline(text: Column, max_level: int) -> Column:
    """Trimmed lines down to an indent level, see ``indent_levels``; a column expression on one row."""

    def measured_line(line: Column) -> Column:
        trimmed = texts.trim_both(line).alias("text")
        return F.struct(trimmed, F.length(F.regexp_extract(line, r"\A[ \t]*", 0)).alias("width"))

    def within(lines: Column) -> Column:
        levels = indent_levels(F.transform(lines, lambda line: line.width))
        placed = F.zip_with(
            lines, levels, lambda line, level: F.struct(line.text.alias("text"), level.alias("level"))
        )
        return F.filter(placed, lambda line: line.level <= max_level)

    lines = F.transform(F.split(text, "\n"), measured_line)
    lines = F.filter(lines, lambda line: line.text != "")
    outline = F.array_join(F.transform(bind(lines, within), lambda line: line.text), " ")
    return F.when(outline != "", outline).otherwise(F.lit(texts.NO_STRUCTURE))


def outline_indent(df: DataFrame, doc_id: str, text: str, max_level: int) -> DataFrame:
    """Lines of indentation-structured code down to an indent level."""
    return df.select(
        F.col(doc_id).alias("doc_id"), indent_outline(F.col(text), max_level).alias("outline")
    )


def outline_kind(ext: Column) -> Column:
    kind = F.lit(UNSUPPORTED)
    for name, value in KIND_OF_EXTENSION.items():
        kind = F.when(ext == name, F.lit(value)).otherwise(kind)
    return kind


def outline_dispatch(catalog: DataFrame, max_depth: int) -> DataFrame:
    """``path, body``: the outline by extension, or a banner and the full content without one.

    Every row of the catalog has a body; a null content counts as empty.
    """
    kind, content = F.col("kind"), F.col("content")
    known = catalog.select(
        "path",
        "ext",
        F.coalesce("content", F.lit("")).alias("content"),
        outline_kind(F.col("ext")).alias("kind"),
    )
    body = (
        F.when(kind == UNSUPPORTED, texts.fallback_text(F.col("path"), F.col("ext"), content))
        .when(kind == INDENTED, indent_outline(content, max_depth))
        .otherwise(joined_leaves(token_nodes(token_array(content, kind), kind), kind, max_depth))
    )
    return known.select("path", body.alias("body"))

"""Globs as column expressions: detection, validation, translation and literal parts.

A glob is matched component by component, so ``*``, ``?`` and classes never match ``/``.  ``**``
must be a whole component and stands for zero or more directories.  Braces are literal.  Case
counts, and leading dots are nothing special.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sheafwork.functions.binding import bind

# The messages of malformed globs.
BAD_STARS = "wildcards are either regular `*` or recursive `**`"
BAD_RECURSION = "recursive wildcards must form a single path component"
BAD_CLASS = "invalid range pattern"
ERROR_FORMAT = "Pattern syntax error near position %d: %s"

# A class holds at least one character, so "[]]" is the class of "]".
_CLASS = r"\[!.[^\]]*\]|\[[^!][^\]]*\]"
_CLASS_IN_COMPONENT = r"\[![^/][^\]/]*\]|\[[^!/][^\]/]*\]"
_STARS = r"(?<=\A|/)\*\*(?:/|\z)|\*(?!\*)"

_ANY_DIRECTORIES = "(?:[^/]+/)*"
_NOTHING = r"[^\x{0}-\x{10FFFF}]"


def is_glob(value: Column) -> Column:
    """True if the input holds any of the characters that start a glob."""
    return value.rlike(r"[*?\[{]")


def _well_formed_prefix(value: Column, char_class: str) -> Column:
    return F.regexp_extract(value, rf"(?s)\A(?:{char_class}|{_STARS}|\?|[^*?\[])*+", 0)


def glob_error(value: Column) -> Column:
    """Why a glob is malformed, with the position of the fault; NULL if it is well formed."""
    whole = _well_formed_prefix(value, _CLASS).alias("whole")
    by_component = _well_formed_prefix(value, _CLASS_IN_COMPONENT).alias("by_component")
    return bind(F.struct(value.alias("value"), whole, by_component), _fault)


def _fault(parsed: Column) -> Column:
    good, good_parts = parsed.whole, parsed.by_component
    at = F.length(good)
    bad = parsed.value.substr(at + 1, F.length(parsed.value))
    own_component = (good == "") | F.endswith(good, F.lit("/"))
    at_in_component = F.length(F.substring_index(good_parts, "/", -1))

    def error(position: Column, message: str) -> Column:
        return F.format_string(ERROR_FORMAT, position, F.lit(message))

    return (
        F.when(F.startswith(bad, F.lit("[")), error(at, BAD_CLASS))
        .when(F.startswith(bad, F.lit("***")), error(at + 2, BAD_STARS))
        .when(F.startswith(bad, F.lit("**")) & own_component, error(at + 2, BAD_RECURSION))
        .when(F.startswith(bad, F.lit("**")), error(at - 1, BAD_RECURSION))
        # A class is cut in two by a slash inside it, which leaves its component malformed.
        .when(F.length(good_parts) < at, error(at_in_component, BAD_CLASS))
    )


def _plain_spelling(value: Column) -> Column:
    """The glob without ``.`` and empty components, and with runs of ``**/`` made one."""
    tidy = F.regexp_replace(value, r"(?<=\A|/)(?:\./|/)+", "")
    return F.regexp_replace(tidy, r"(?:\*\*/){2,}", "**/")


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.^$|(){}+\]])", r"\\$1")


def _escaped_in_class(char: Column) -> Column:
    return F.regexp_replace(char, r"([\\\]\[^&-])", r"\\$1")


def _class_member(member: Column) -> Column:
    """A single character or an ``x-y`` range, with ``/`` cut out of the range."""
    low, high = member.substr(1, 1), member.substr(3, 1)
    dash = F.lit("-")
    below = F.when(low <= ".", F.concat(_escaped_in_class(low), F.lit("-."))).otherwise(F.lit(""))
    above = F.when(high >= "0", F.concat(F.lit("0-"), _escaped_in_class(high))).otherwise(F.lit(""))
    return (
        F.when(F.length(member) == 1, _escaped_in_class(member))
        .when(low > high, F.lit(""))
        .when((low <= "/") & (high >= "/"), F.concat(below, above))
        .otherwise(F.concat(_escaped_in_class(low), dash, _escaped_in_class(high)))
    )


def _class_regex(token: Column) -> Column:
    negated = F.startswith(token, F.lit("[!"))
    body = F.regexp_extract(token, r"(?s)\A\[!?(.*)\]\z", 1)
    members = F.array_join(
        F.transform(F.regexp_extract_all(body, F.lit("(?s).-.|."), F.lit(0)), _class_member), ""
    )
    return (
        F.when(negated, F.concat(F.lit("[^/"), members, F.lit("]")))
        .when(members == "", F.lit(_NOTHING))
        .otherwise(F.concat(F.lit("["), members, F.lit("]")))
    )


def _token_regex(token: Column) -> Column:
    return (
        F.when(token == "**/", F.lit(_ANY_DIRECTORIES))
        .when(token == "*", F.lit("[^/]*"))
        .when(token == "?", F.lit("[^/]"))
        .when(F.startswith(token, F.lit("[")), _class_regex(token))
        .otherwise(_escaped(token))
    )


def can_select_files(value: Column) -> Column:
    """True for a well-formed glob that may select a file of the catalog.

    One that ends in ``/`` or ``**`` selects directories only, and an absolute one looks outside
    the catalog.
    """
    return ~value.rlike(r"\A/|/\.?\z|(?:\A|/)\*\*\z") & glob_error(value).isNull()


def translated(value: Column) -> Column:
    """Regex for a glob that ``can_select_files``."""
    tokens = F.regexp_extract_all(
        _plain_spelling(value), F.lit(rf"(?s)\*\*/|\*|\?|{_CLASS}|[^*?\[]+"), F.lit(0)
    )
    return F.concat(
        F.lit(r"\A(?:"), F.array_join(F.transform(tokens, _token_regex), ""), F.lit(r")\z")
    )


def glob_to_regex(value: Column) -> Column:
    """Regex for the paths a glob selects; NULL if it is malformed or can select no file."""
    return F.when(can_select_files(value), translated(value))


def glob_literals(value: Column) -> Column:
    """Strings that every ``'/' + path + '/'`` selected by the glob contains."""
    framed = F.concat(F.lit("/"), _plain_spelling(value), F.lit("/"))
    marked = F.regexp_replace(framed, r"\*\*/", "\x00/")
    marked = F.regexp_replace(marked, rf"(?s)\*|\?|{_CLASS}", "\x00")
    return F.split(marked, "\x00")

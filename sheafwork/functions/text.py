"""Column functions on text: sizes, trimming, quoting and fenced blocks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The 25 characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Output formats and message texts.
NO_STRUCTURE = "(No structure found)"
NOT_UTF8 = "stream did not contain valid UTF-8"
READ_ERROR_FORMAT = "Error: Could not read file content for %s.\nDetails: %s"
UNSUPPORTED_FORMAT = "Language support not configured for file extension: '%s'"
FALLBACK_FORMAT = (
    "---\n-- ERROR: Could not extract symbols from %s: %s\n"
    "-- Falling back to full file content.\n---\n\n%s"
)


def line_count(text: Column) -> Column:
    """Number of lines; a final newline adds none and empty text has none."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    open_line = (text != "") & ~F.endswith(text, F.lit("\n"))
    return (newlines + open_line.cast("int")).cast("bigint")


def char_count(text: Column) -> Column:
    """Number of code points."""
    return F.length(text).cast("bigint")


def byte_count(text: Column) -> Column:
    """Number of UTF-8 bytes."""
    return F.octet_length(text).cast("bigint")


def trim_end(text: Column) -> Column:
    """Strip trailing Unicode white space.

    Most texts end in none, which the last character tells without a look at the rest.
    """
    last = F.right(text, F.lit(1))
    ends_in_space = F.contains(F.lit(WHITE_SPACE), last) & (last != "")
    return F.when(ends_in_space, F.rtrim(text, F.lit(WHITE_SPACE))).otherwise(text)


def trim_both(text: Column) -> Column:
    """Strip Unicode white space on both sides."""
    return F.trim(text, F.lit(WHITE_SPACE))


def quoted(text: Column) -> Column:
    """``text`` in double quotes, with quotes, backslashes and control characters escaped.

    Control characters without a short form become ``\\u{...}`` with their code in hexadecimal.
    """
    for raw, escaped in (
        ("\\", "\\\\"),
        ('"', '\\"'),
        ("\n", "\\n"),
        ("\r", "\\r"),
        ("\t", "\\t"),
        ("\x00", "\\0"),
    ):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    spelled = text
    for code in (*range(1, 9), 11, 12, *range(14, 32), *range(127, 160)):
        spelled = F.replace(spelled, F.lit(chr(code)), F.lit(f"\\u{{{code:x}}}"))
    text = F.when(F.rlike(text, F.lit(r"[\x01-\x1f\x7f-\x9f]")), spelled).otherwise(text)
    return F.concat(F.lit('"'), text, F.lit('"'))


def fence_block(path: Column, hint: Column, content: Column) -> Column:
    """One Markdown block: path, fence with language hint, content, fence, blank line.

    A fence inside the content is not escaped.
    """
    return F.concat(
        path, F.lit("\n```"), hint, F.lit("\n"), trim_end(content), F.lit("\n```\n\n")
    )


def read_error_text(path: Column, error: Column) -> Column:
    """Text that stands in a block for content that could not be read."""
    return F.format_string(READ_ERROR_FORMAT, quoted(path), error)


def fallback_text(path: Column, ext: Column, content: Column) -> Column:
    """Banner and full content for a document whose extension has no outline."""
    reason = F.format_string(UNSUPPORTED_FORMAT, ext)
    return F.format_string(FALLBACK_FORMAT, quoted(path), reason, content)

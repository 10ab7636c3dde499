"""Reports on requests that failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sheafwork.functions import paths, text as texts
from sheafwork.operators import cascade
from sheafwork.operators.cascade import Resolution, request_gate, resolution_status
from sheafwork.operators.scale import balanced_join, running_totals, union_all
from sheafwork.operators.selection import chosen_files
from sheafwork.session import materialize

# How many conflicting paths are shown, and the texts of the report.
SHOWN = 8
HEADING = "Could not proceed due to unresolved inputs:"
CLOSING = "Please resolve the issues above and try again."
NO_SUCH_PATH_TITLE = "The following specified paths do not exist:"
INVALID_GLOB_TITLE = "The following glob patterns are invalid:"
NOT_FOUND_TITLE = "The following inputs could not be found:"
AMBIGUOUS_TITLE = "The following inputs are ambiguous:"
MISSING_TITLE = "The following inputs are missing:"
RESOLVED_TITLE = "However, these files were successfully resolved:"
NO_SUCH_PATH_LINE = "  • Input: '%s' (checked: %s)"
INVALID_GLOB_LINE = "  • Input: '%s' (error: %s)"
NOT_FOUND_LINE = "  • Input: '%s'"
AMBIGUOUS_LINE = "  • Input '%s' matched:"
CONFLICT_LINE = "    → %s"
MORE_LINE = "    → ... and %d more match%s."
MISSING_LINE = "  • Input number %d"
RESOLVED_LINE = "  ✓ %s"


def _previews(resolution: Resolution, shown: int) -> DataFrame:
    """``input, match_no, path, n_matches``; only the first rows of each input are shuffled."""
    first = Window.partitionBy("input").orderBy(paths.path_order(F.col("path")))
    top = (
        resolution.conflicts()
        .select("input", "path", F.row_number().over(first).alias("match_no"))
        .filter(F.col("match_no") <= shown)
    )
    n_matches = resolution.outcomes.select("input", "n_matches")
    return balanced_join(top, n_matches, ["input"], bound=resolution.outcomes)


def conflict_preview(resolution: Resolution, shown: int = SHOWN) -> DataFrame:
    """The first conflicting paths of each ambiguous input, and how many there are beyond."""
    more = F.greatest(F.col("n_matches") - shown, F.lit(0))
    rows = _previews(resolution, shown).withColumn("n_more", more)
    return resolution.per_request(rows)


def _lines(rows: DataFrame, section_no: int, section: str, text: Column, line_no=None) -> DataFrame:
    line_no = F.lit(0) if line_no is None else line_no
    return rows.select(
        "request_id",
        F.lit(section_no).alias("section_no"),
        F.lit(section).alias("section"),
        "input_ord",
        line_no.cast("bigint").alias("line_no"),
        text.alias("text"),
    )


def error_report(resolution: Resolution, shown: int = SHOWN) -> DataFrame:
    """One report per failed request, as lines.

    The lines are read in the order of ``request_id, section_no, input_ord, line_no``.  Sections
    without a line are left out; the heading and the closing line have ``input_ord`` -1.
    """
    status = resolution_status(resolution)
    value = F.col("input")

    def of(name: str) -> DataFrame:
        return status.filter(F.col("status") == name)

    failed = request_gate(status).filter(~F.col("passed")).withColumn("input_ord", F.lit(-1))
    ambiguous = of(cascade.AMBIGUOUS)
    more = F.col("n_matches") - shown
    plural = F.when(more == 1, F.lit("")).otherwise(F.lit("es"))
    resolved = running_totals(
        materialize(chosen_files(resolution, passed=False), "resolved-files"),
        ["request_id"],
        [F.col("input_ord"), paths.path_order(F.col("path"))],
        {"before": F.lit(1)},
    )
    return union_all(
        _lines(failed, 0, "", F.lit(HEADING)),
        _lines(
            of(cascade.NO_SUCH_PATH),
            1,
            NO_SUCH_PATH_TITLE,
            F.format_string(NO_SUCH_PATH_LINE, value, texts.quoted(F.col("path_tried"))),
        ),
        _lines(
            of(cascade.INVALID_GLOB),
            2,
            INVALID_GLOB_TITLE,
            F.format_string(INVALID_GLOB_LINE, value, F.col("error")),
        ),
        _lines(of(cascade.NOT_FOUND), 3, NOT_FOUND_TITLE, F.format_string(NOT_FOUND_LINE, value)),
        _lines(ambiguous, 4, AMBIGUOUS_TITLE, F.format_string(AMBIGUOUS_LINE, value)),
        _lines(
            resolution.per_request(_previews(resolution, shown)),
            4,
            AMBIGUOUS_TITLE,
            F.format_string(CONFLICT_LINE, texts.quoted(F.col("path"))),
            F.col("match_no"),
        ),
        _lines(
            ambiguous.filter(more > 0),
            4,
            AMBIGUOUS_TITLE,
            F.format_string(MORE_LINE, more, plural),
            F.lit(shown + 1),
        ),
        _lines(
            of(cascade.MISSING_INPUT),
            5,
            MISSING_TITLE,
            F.format_string(MISSING_LINE, F.col("input_ord") + 1),
        ),
        _lines(
            resolved,
            6,
            RESOLVED_TITLE,
            F.format_string(RESOLVED_LINE, texts.quoted(F.col("path"))),
            F.col("before") + 1,
        ),
        _lines(failed, 7, "", F.lit(CLOSING)),
    )

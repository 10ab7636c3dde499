"""Resolve requests: exact path, then glob, then substring, with one outcome per input."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sheafwork.functions import globs, paths
from sheafwork.operators import matching
from sheafwork.operators.scale import balanced_join, union_all
from sheafwork.session import materialize, measured, with_size

SUCCESS = "Success"
AMBIGUOUS = "Ambiguous"
INVALID_GLOB = "InvalidGlobPattern"
NOT_FOUND = "NotFound"
NO_SUCH_PATH = "PathDoesNotExist"
#: Of an input that is NULL, as of a request without inputs.
MISSING_INPUT = "MissingInput"


@dataclass(frozen=True)
class Resolution:
    """What was found for a batch of requests, per distinct input.

    The frames are written to the shared folder.  The paths of ambiguous inputs are not among
    them, as they may be very many; ``conflicts`` looks them up when they are asked for.
    """

    requests: DataFrame
    catalog: DataFrame
    outcomes: DataFrame  #: input, status, tier, n_matches, error, path_tried
    files: DataFrame  #: input, tier, path, canonical_key of the inputs that succeeded
    patterns: DataFrame  #: input, tier, regex, piece, piece_length of globs and substrings

    def conflicts(self) -> DataFrame:
        """``input, tier, path, canonical_key`` of every match of the ambiguous inputs."""
        several = self.outcomes.filter(F.col("status") == AMBIGUOUS).select("input")
        patterns = balanced_join(
            self.patterns, several, ["input"], how="left_semi", bound=self.outcomes
        )
        patterns = with_size(patterns, measured(self.patterns))
        return matching.candidates(patterns, self.catalog, matching.SUBSTRING)

    def matches(self) -> DataFrame:
        """Every match of every request, those of ambiguous inputs included."""
        return self.per_request(self.files.unionByName(self.conflicts()))

    def per_request(self, rows: DataFrame) -> DataFrame:
        """Rows per input, given to each request that has the input."""
        return self.fan_out(self.requests, rows).select(
            *self.requests.columns, *[c for c in rows.columns if c != "input"]
        )

    def fan_out(self, requests: DataFrame, rows: DataFrame) -> DataFrame:
        """Join some of the requests with rows per input, no more per input than its matches."""
        at_most = self.outcomes.select("input", F.col("n_matches").alias("rows"))
        return balanced_join(
            requests, rows, ["input"], small="left", bound=self.requests, right_rows=at_most
        )


def resolve(requests: DataFrame, catalog: DataFrame, root: str = paths.ROOT) -> Resolution:
    """Resolve each distinct input once; only those a tier leaves open go on to the next."""
    requests = materialize(requests, "requests", missing=F.count_if(F.col("input").isNull()))
    inputs = materialize(matching.distinct_inputs(requests), "inputs")

    exact = materialize(matching.match_exact(inputs, catalog), "exact-matches")
    tallies = materialize(_exact_tally(exact), "exact-counts", both=F.count_if("both"))
    if measured(tallies).metrics["both"]:
        # A path that is a file is not looked at as a directory, even if others lie below it.
        exact = balanced_join(
            exact, tallies.select("input", "tier"), ["input", "tier"], "left_semi", bound=tallies
        )
    tallies = with_size(tallies.drop("both"), measured(tallies))

    left = matching.unmatched_inputs(inputs, tallies)
    patterns = matching.rarest_pieces(matching.path_patterns(left), catalog)
    files = exact
    if measured(patterns).rows:
        globbed = materialize(matching.candidates(patterns, catalog, matching.GLOB), "glob-matches")
        # Of a substring's matches only the number is needed, and the match itself if it is the
        # only one, so they are never held as rows.
        partial = matching.candidates(patterns, catalog, matching.SUBSTRING)
        only = [F.min(name).alias(name) for name in ("path", "canonical_key")]
        counted = materialize(_tally(partial, *only), "substring-counts")
        single = counted.filter("n_matches = 1").drop("n_matches")
        files = union_all(exact, globbed, single)
        tallies = union_all(tallies, _tally(globbed), counted.drop("path", "canonical_key"))
    outcomes = materialize(input_outcomes(inputs, tallies, root), "outcomes")
    return Resolution(requests, catalog, outcomes, files, patterns)


def _exact_tally(exact: DataFrame) -> DataFrame:
    def count(tier: str) -> Column:
        return F.count_if(F.col("tier") == tier)

    n_files, n_below = F.col("n_files"), F.col("n_below")
    counts = exact.groupBy("input").agg(
        count(matching.FILE).alias("n_files"), count(matching.DIRECTORY).alias("n_below")
    )
    return counts.select(
        "input",
        F.when(n_files > 0, F.lit(matching.FILE)).otherwise(matching.DIRECTORY).alias("tier"),
        F.when(n_files > 0, n_files).otherwise(n_below).alias("n_matches"),
        ((n_files > 0) & (n_below > 0)).alias("both"),
    )


def _tally(matches: DataFrame, *more: Column) -> DataFrame:
    return matches.groupBy("input", "tier").agg(F.count("*").alias("n_matches"), *more)


def input_outcomes(inputs: DataFrame, tallies: DataFrame, root: str = paths.ROOT) -> DataFrame:
    """One status per input, from the number of matches and the tier they came from."""
    value = F.col("input")
    glob = globs.is_glob(value)
    found = F.col("n_matches") > 0
    open_status = (
        F.when(glob & F.col("error").isNotNull(), F.lit(INVALID_GLOB))
        .when(~glob & F.contains(value, F.lit("/")), F.lit(NO_SUCH_PATH))
        .otherwise(F.lit(NOT_FOUND))
    )
    status = (
        F.when(found & (F.col("tier") == matching.SUBSTRING) & (F.col("n_matches") > 1), AMBIGUOUS)
        .when(found, SUCCESS)
        .otherwise(open_status)
    )
    joined = balanced_join(inputs, tallies, ["input"], how="left", bound=inputs)
    joined = joined.withColumn("n_matches", F.coalesce("n_matches", F.lit(0))).withColumn(
        "error", F.when(glob & (F.col("n_matches") == 0), globs.glob_error(value))
    )
    return joined.select(
        "input",
        status.alias("status"),
        "tier",
        "n_matches",
        "error",
        F.when(status == NO_SUCH_PATH, paths.path_tried(value, root)).alias("path_tried"),
    )


def resolution_status(resolution: Resolution) -> DataFrame:
    """One row per input of each request, repeated inputs included."""
    columns = ["request_id", "input_ord", "input", "status", "tier", "n_matches", "error", "path_tried"]
    requests, outcomes = resolution.requests, resolution.outcomes
    status = balanced_join(requests, outcomes, ["input"], split="left").select(*columns)
    size = measured(requests)
    if size and not size.metrics.get("missing", 1):
        return status
    none = {c: F.lit(None).cast("string").alias(c) for c in ("tier", "error", "path_tried")}
    known = {"status": F.lit(MISSING_INPUT).alias("status"), "n_matches": F.lit(0).cast("bigint").alias("n_matches")}
    missing = requests.filter(F.col("input").isNull()).select(*[{**none, **known}.get(c, F.col(c)) for c in columns])
    return status.unionByName(missing)


def outcome_counts(status: DataFrame) -> DataFrame:
    """Number of inputs per request in each outcome."""

    def count(value: str) -> Column:
        return F.count_if(F.col("status") == value)

    return status.groupBy("request_id").agg(
        count(SUCCESS).alias("n_success"),
        count(AMBIGUOUS).alias("n_ambiguous"),
        count(INVALID_GLOB).alias("n_invalid_glob"),
        count(NOT_FOUND).alias("n_not_found"),
        count(NO_SUCH_PATH).alias("n_path_does_not_exist"),
        count(MISSING_INPUT).alias("n_missing_input"),
    )


def request_gate(status: DataFrame) -> DataFrame:
    """Whether each request goes on: only if every input succeeded, hence with a file at least."""
    return status.groupBy("request_id").agg(
        F.every(F.col("status") == SUCCESS).alias("passed")
    )

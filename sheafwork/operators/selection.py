"""Choose the files of each request and put them in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sheafwork.functions import paths
from sheafwork.operators.cascade import Resolution, request_gate, resolution_status
from sheafwork.operators.scale import balanced_join


def keep_first(matches: DataFrame) -> DataFrame:
    """Each file once per request, where it was first chosen: by input, then by path.

    An aggregate, not a window: a request with very many rows is reduced before the shuffle.
    """
    order = paths.path_order(F.col("path")).alias("path_order")
    first = F.min(F.struct("input_ord", order, "path")).alias("first")
    return (
        matches.groupBy("request_id", "canonical_key")
        .agg(first)
        .select("request_id", "first.input_ord", "first.path", "canonical_key")
    )


def ordered_candidates(matches: DataFrame) -> DataFrame:
    """Candidates without repeats, in path order within each input."""
    rows = matches.select("request_id", "input_ord", "path").distinct()
    return rows.orderBy("request_id", "input_ord", paths.path_order(F.col("path")))


def chosen_files(resolution: Resolution, passed: bool | None = True) -> DataFrame:
    """The files of each request that passed (or failed, or of all if None), each once."""
    requests = resolution.requests
    if passed is not None:
        gate = request_gate(resolution_status(resolution))
        gate = gate.filter(F.col("passed") == passed).select("request_id")
        requests = balanced_join(
            requests, gate, ["request_id"], how="left_semi", bound=resolution.requests
        )
    files = resolution.files.select("input", "path", "canonical_key")
    return keep_first(resolution.fan_out(requests, files))


def attach_content(
    files: DataFrame, rendered: DataFrame, bound: DataFrame | None = None
) -> DataFrame:
    """Columns of ``rendered`` (one row per path) for the chosen files.

    The chosen files are broadcast if they measure small, so that content is not shuffled;
    otherwise both sides are shuffled by path, with paths that very many requests chose split.
    """
    return balanced_join(files, rendered, ["path"], small="left", bound=bound, split="left")

"""Match inputs against catalog paths: exact file, directory, glob and substring.

Each ``match_*`` takes distinct inputs (``input``) and a catalog, and gives the rows
``input, tier, path, canonical_key``.  Inputs are matched once, however many requests share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sheafwork.functions import globs, paths
from sheafwork.operators.scale import balanced_join, fits_broadcast, possibly_in
from sheafwork.session import materialize, measured, with_size

FILE, DIRECTORY, GLOB, SUBSTRING = "file", "directory", "glob", "substring"
MATCH_COLUMNS = ["input", "tier", "path", "canonical_key"]

#: Substrings of a path are looked up by pieces of these lengths; a longer one is more selective.
PIECE_LENGTHS = (8, 3, 2, 1)


def distinct_inputs(requests: DataFrame) -> DataFrame:
    return requests.select("input").filter(F.col("input").isNotNull()).distinct()


def match_direct(inputs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Inputs that are the path of a file."""
    wanted = inputs.select("input", paths.lookup_path(F.col("input")).alias("path")).filter(
        F.col("path").isNotNull() & ~paths.names_directory(F.col("input"))
    )
    files = catalog.select("path", "canonical_key")
    hits = balanced_join(wanted, files, ["path"], small="left", bound=inputs, split="left")
    return hits.withColumn("tier", F.lit(FILE)).select(*MATCH_COLUMNS)


def match_directory(inputs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Inputs that are a directory, with every file below it at any depth.

    Each path is listed under all its directories, so this is an equi-join.
    """
    wanted = inputs.select("input", paths.lookup_path(F.col("input")).alias("directory")).filter(
        F.col("directory").isNotNull()
    )
    listed = catalog.select(
        F.explode(paths.ancestors(F.col("path"))).alias("directory"), "path", "canonical_key"
    )
    hits = balanced_join(listed, wanted, ["directory"], bound=inputs, split="left")
    return hits.withColumn("tier", F.lit(DIRECTORY)).select(*MATCH_COLUMNS)


def match_exact(inputs: DataFrame, catalog: DataFrame) -> DataFrame:
    """``match_direct`` and ``match_directory`` in one reading of the paths."""
    value, path = F.col("input"), F.col("path")
    wanted = inputs.select(
        "input",
        paths.lookup_path(value).alias("name"),
        paths.names_directory(value).alias("directory_only"),
    ).filter(F.col("name").isNotNull())
    names = F.concat(paths.ancestors(path), F.array(path))
    listed = catalog.select(F.explode(names).alias("name"), "path", "canonical_key")
    hits = balanced_join(listed, wanted, ["name"], bound=inputs, split="left")
    is_file = F.col("name") == path
    tier = F.when(is_file, F.lit(FILE)).otherwise(F.lit(DIRECTORY)).alias("tier")
    return hits.filter(~(is_file & F.col("directory_only"))).select(
        "input", tier, "path", "canonical_key"
    )


def match_glob(inputs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Inputs that are a well-formed glob, with every file it selects."""
    inputs = inputs.filter(globs.is_glob(F.col("input")))
    return candidates(rarest_pieces(path_patterns(inputs), catalog), catalog, GLOB)


def match_substring(inputs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Inputs that occur in a path; case counts.  Globs are not looked for literally."""
    inputs = inputs.filter(~globs.is_glob(F.col("input")))
    return candidates(rarest_pieces(path_patterns(inputs), catalog), catalog, SUBSTRING)


def unmatched_inputs(requests: DataFrame, matches: DataFrame) -> DataFrame:
    """Requests' inputs without any row in ``matches``."""
    matched = matches.select("input").distinct()
    return balanced_join(requests, matched, ["input"], how="left_anti", bound=matches)


# --- patterns -----------------------------------------------------------------------------------
#
# A glob or substring cannot be an equi-join as it stands.  But a path it selects must contain
# every literal piece of it, so one piece of each pattern, the one found in the fewest paths, is
# joined to the pieces of all paths.  Only the pairs that share it are tested in full.


def path_patterns(inputs: DataFrame) -> DataFrame:
    """``input, tier, regex, literals``: what to look for in the paths for each input.

    Malformed globs and those that can select no file are left out.
    """
    value = F.col("input")
    glob = globs.is_glob(value)
    return inputs.filter(~glob | globs.can_select_files(value)).select(
        "input",
        F.when(glob, F.lit(GLOB)).otherwise(F.lit(SUBSTRING)).alias("tier"),
        F.when(glob, globs.translated(value)).alias("regex"),
        F.when(glob, globs.glob_literals(value)).otherwise(F.array(value)).alias("literals"),
    )


def _pieces(text: Column, length: Column) -> Column:
    """All substrings of ``text`` with that length."""
    starts = F.sequence(F.lit(1), F.length(text) - length + 1)
    every = F.transform(starts, lambda start: text.substr(start, length))
    return F.when(F.length(text) >= length, every).otherwise(F.array().cast("array<string>"))


def _usable_length(literals: Column) -> Column:
    longest = F.array_max(F.transform(literals, F.length))
    usable = F.lit(None).cast("int")
    for length in sorted(PIECE_LENGTHS):
        usable = F.when(longest >= length, F.lit(length)).otherwise(usable)
    return usable


def _path_pieces(catalog: DataFrame, lengths: list[int], *columns: str) -> DataFrame:
    """``columns, framed, start, piece``: every piece of ``'/' + path + '/'`` with its place.

    Explode and substring are compiled code, which cutting pieces by a lambda is not.
    """
    if not lengths:  # No pattern to look for: do not read the paths.
        catalog, lengths = catalog.filter(F.lit(False)), PIECE_LENGTHS
    framed, start = F.col("framed"), F.col("start")
    rows = catalog.select(
        *columns, F.concat(F.lit("/"), F.col("path"), F.lit("/")).alias("framed")
    ).select("*", F.explode(F.sequence(F.lit(1), F.length(framed))).alias("start"))
    pieces = [F.when(start <= F.length(framed) - n + 1, framed.substr(start, F.lit(n))) for n in lengths]
    piece = pieces[0] if len(pieces) == 1 else F.explode(F.array(*pieces))
    return rows.select("*", piece.alias("piece")).filter(F.col("piece").isNotNull())


def rarest_pieces(patterns: DataFrame, catalog: DataFrame) -> DataFrame:
    """``input, tier, regex, piece_length, piece, n_held``: the piece to look each pattern up by.

    ``n_held`` is how often the paths hold it.  Patterns with a piece that no path holds select
    nothing and are left out.
    """
    pieces = patterns.withColumn("piece_length", _usable_length(F.col("literals"))).select(
        "input",
        "tier",
        "regex",
        "piece_length",
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.transform("literals", lambda text: _pieces(text, F.col("piece_length")))
                )
            )
        ).alias("piece"),
    )
    pieces = materialize(pieces, "pattern-pieces", **_length_metrics())
    if not measured(pieces).rows:
        return with_size(pieces.withColumn("n_held", F.lit(0)), measured(pieces))
    held = _path_pieces(catalog, _lengths_in_use(pieces)).select("piece")
    wanted = pieces.select("piece").distinct()
    if fits_broadcast(wanted, bound=pieces):
        held = held.join(F.broadcast(wanted), ["piece"], "left_semi")
    else:
        held = possibly_in(held, wanted, "piece")
    # Counted before the shuffle: a piece that most paths hold is one row per task.
    counts = held.groupBy("piece").agg(F.count("*").alias("n_held"))
    counted = balanced_join(pieces, counts, ["piece"], "left", bound=pieces)
    n_held = F.coalesce("n_held", F.lit(0)).alias("n_held")
    rarest = (
        counted.groupBy("input", "tier", "regex", "piece_length")
        .agg(F.min(F.struct(n_held, "piece")).alias("rarest"))
        .select("input", "tier", "regex", "piece_length", "rarest.piece", "rarest.n_held")
        .filter("n_held > 0")
    )
    return materialize(rarest, "rarest-pieces", **_length_metrics())


def _length_metrics() -> dict[str, Column]:
    length, tier = F.col("piece_length"), F.col("tier")
    return {
        f"{name}_{n}": F.count_if((tier == name) & (length == n))
        for name in (GLOB, SUBSTRING)
        for n in PIECE_LENGTHS
    }


def _lengths_in_use(patterns: DataFrame, *tiers: str) -> list[int]:
    metrics = measured(patterns).metrics
    tiers = tiers or (GLOB, SUBSTRING)
    return [n for n in PIECE_LENGTHS if any(metrics[f"{tier}_{n}"] for tier in tiers)]


def candidates(patterns: DataFrame, catalog: DataFrame, tier: str) -> DataFrame:
    """The matches of a tier's ``rarest_pieces``: paths that hold the piece and pass the full test."""
    held = _path_pieces(catalog, _lengths_in_use(patterns, tier), "path", "canonical_key")
    chosen = patterns.filter(F.col("tier") == tier)
    if not fits_broadcast(patterns):
        # Most pieces of most paths are no pattern's: they are dropped where they are cut.
        held = possibly_in(held, chosen.select("piece"), "piece")
    pairs = balanced_join(
        held,
        chosen.select("input", "tier", "regex", "piece"),
        ["piece"],
        bound=patterns,
        left_rows=chosen.groupBy("piece").agg(F.max("n_held").alias("rows")),
    )
    path = F.col("path")
    selected = F.when(F.col("regex").isNull(), F.contains(path, F.col("input"))).otherwise(
        F.rlike(path, F.col("regex"))
    )
    # A path that holds the piece more than once counts where it does so first.
    first = F.position("piece", "framed") == F.col("start")
    return pairs.filter(first & selected).select(*MATCH_COLUMNS)

"""Names that stand for other names: chains followed to their ends, and files known by several names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sheafwork.functions import paths
from sheafwork.operators.scale import balanced_join, union_all
from sheafwork.session import materialize, measured

CYCLE = "alias leads into a cycle"
CONFLICT = "alias has several targets"
NO_TARGET = "alias has no target"


def resolve_aliases(aliases: DataFrame, alias: str = "alias", target: str = "target") -> DataFrame:
    """``alias, target, hops, error``: the end of the chain of each alias, one row per alias.

    An end is a name that is no alias itself.  An alias with several targets, with none but NULL, or
    whose chain leads into a cycle or to such an alias has an error, and neither target nor hops.
    Rows repeat without effect; a NULL alias names nothing and has no row.

    Pointer doubling: in each round every open alias takes over where the name it points to has
    got, so the steps behind it double, and a chain of n takes about log2(n) rounds.  An alias still
    open after more steps than there are aliases has met one twice.  Ended aliases are only read.
    """
    name, end = F.col(f"`{alias}`"), F.col(f"`{target}`")
    known = (
        aliases.select(name.alias("alias"), end.alias("target"))
        .where("alias is not null")
        .groupBy("alias")
        .agg(F.min("target").alias("at"), F.max("target").alias("other"))
    )
    fault = F.when(F.col("at").isNull(), NO_TARGET).when(F.col("at") != F.col("other"), CONFLICT)
    start = known.select(
        "alias", "at", F.lit(1).cast("bigint").alias("hops"), fault.alias("error"), fault.isNotNull().alias("ended")
    )
    step = _written(start)
    total, rounds, done = measured(step).rows, 0, []
    while _open(step) and (1 << rounds) <= total:
        done.append(step.where("ended"))
        still = step.where("not ended")
        there = union_all(*done, still).select(
            F.col("alias").alias("at"),
            F.col("at").alias("_at"),
            F.col("hops").alias("_hops"),
            F.col("error").alias("_error"),
            F.col("ended").alias("_ended"),
        )
        # At most one row per name there, however many aliases point to it.
        met = balanced_join(still, there, ["at"], how="left")
        step = _written(
            met.select(
                "alias",
                F.coalesce("_at", "at").alias("at"),
                (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
                F.col("_error").alias("error"),
                F.coalesce("_ended", F.lit(True)).alias("ended"),
            )
        )
        rounds += 1
    ends = union_all(*done, step)
    error = F.coalesce("error", F.when(~F.col("ended"), CYCLE))
    whole = error.isNull()
    return ends.select(
        "alias", F.when(whole, F.col("at")).alias("target"), F.when(whole, F.col("hops")).alias("hops"), error.alias("error")
    )


def with_aliases(catalog: DataFrame, resolved: DataFrame) -> DataFrame:
    """A catalog whose aliases have the canonical key of the file they stand for, so that it is kept once.

    A path whose alias has an error becomes unreadable, with that error.  ``resolved`` is from
    ``resolve_aliases``; a target that is in no catalog still makes its aliases one file.
    """
    names = resolved.select(
        F.col("alias").alias("path"), paths.canonical_key(F.col("target")).alias("_key"), F.col("error").alias("_fault")
    )
    # Keys of the catalog's own making stay those of the files that are aliases' ends.
    own = catalog.select(F.col("path").alias("_end"), F.col("canonical_key").alias("_own"))
    ends = resolved.where("target is not null").select("alias", F.col("target").alias("_end"))
    found = balanced_join(ends, own, ["_end"]).select(F.col("alias").alias("path"), "_own")
    names = balanced_join(names, found, ["path"], how="left")
    joined = balanced_join(catalog, names, ["path"], how="left")
    changed = {
        "canonical_key": F.coalesce("_own", "_key", "canonical_key"),
        "content": F.when(F.col("_fault").isNull(), F.col("content")),
        "read_error": F.coalesce("_fault", "read_error"),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else c for c in catalog.columns])


def _written(step: DataFrame) -> DataFrame:
    return materialize(step, "aliases", open=F.sum((~F.col("ended")).cast("bigint")))


def _open(step: DataFrame) -> int:
    return measured(step)[2]["open"] or 0

"""Exact k-th element and row positions per stratum without gathering a stratum.

Strata are few and large (classes), so a window over a stratum would put a
third of the corpus in one task. Instead the leading digits of a uniform hash
rank form buckets, a small histogram finds the bucket that holds each cut, and
only the rows of those buckets are ordered.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copycensus.session import join_safe, materialize


def boundaries(
    rows: DataFrame,
    strata: list[str],
    order: str,
    targets: DataFrame | Callable[[DataFrame], DataFrame],
    weight: str | None = None,
    digits: int = 3,
) -> DataFrame:
    """Order key at which the running weight of a stratum first reaches each target.

    ``rows`` has the strata columns and ``order``, a unique string that starts
    with a uniform hex rank. ``targets`` has (strata, cut, target), targets >= 1,
    or is a function that makes that table from the (strata, total) weights.
    Returns (strata, cut, boundary, reached); a target that is never reached
    yields no row. The result has one row per target.
    """
    load = F.col(weight) if weight else F.lit(1).cast("long")
    keyed = rows.select(
        *strata, F.col(order).alias("_order"), load.alias("_load"),
        F.substring(order, 1, digits).alias("_bucket"),
    )
    # At most 16**digits rows per stratum.
    histogram = materialize(keyed.groupBy(*strata, "_bucket").agg(F.sum("_load").alias("_sum")))
    if callable(targets):
        targets = targets(histogram.groupBy(*strata).agg(F.sum("_sum").alias("total")))
    running = W.partitionBy(*strata).orderBy("_bucket")
    before = histogram.withColumn("_upto", F.sum("_sum").over(running))
    earlier = F.col("_upto") - F.col("_sum")
    cut_buckets = materialize(
        join_safe(before, targets, strata)
        .where((F.col("_upto") >= F.col("target")) & (earlier < F.col("target")))
        .select(*strata, "_bucket", "cut", (F.col("target") - earlier).alias("_need"), earlier.alias("_before"))
    )
    # Rows of one bucket per cut.
    inside = W.partitionBy(*strata, "cut").orderBy("_order")
    ranked = join_safe(keyed, cut_buckets, [*strata, "_bucket"]).withColumn("_run", F.sum("_load").over(
        inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    ))
    crossing = (F.col("_run") >= F.col("_need")) & (F.col("_run") - F.col("_load") < F.col("_need"))
    return ranked.where(crossing).select(
        *strata, "cut", F.col("_order").alias("boundary"),
        (F.col("_before") + F.col("_run")).alias("reached"),
    )


def boundaries_wide(found: DataFrame, strata: list[str], cuts: list[str]) -> DataFrame:
    """One row per stratum with a column per cut; materialized, so its size is known."""
    return materialize(
        found.groupBy(*strata).agg(
            *[F.max(F.when(F.col("cut") == c, F.col("boundary"))).alias(f"_cut_{c}") for c in cuts]
        )
    )


def positions(rows: DataFrame, groups: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Exact 1-based position inside each group, however large the group is.

    Rows are range-partitioned on (group, order); each slice is numbered on its
    own and shifted by the counts of the slices before it. ``order`` must be unique.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = materialize(
        rows.repartitionByRange(parts, *groups, *order).withColumn("_slice", F.spark_partition_id())
    )
    # One row per (group, slice).
    counts = sliced.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy(*groups).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*groups)
    shifts = materialize(
        counts.withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .withColumn("group_rows", F.sum("_rows").over(whole))
        .drop("_rows")
    )
    local = W.partitionBy(*groups, "_slice").orderBy(*order)
    return (
        join_safe(sliced, shifts, [*groups, "_slice"])
        .withColumn(name, F.row_number().over(local).cast("long") + F.col("_shift"))
        .drop("_slice", "_shift")
    )


#: Hex digits by which each pass of ``rank_cuts`` narrows a bucket, and rows that a bucket may have when it is ordered.
PASS_DIGITS, ORDERED_ROWS = 3, 100_000


def rank_cuts(
    sources: list[tuple[DataFrame, dict[str, Column]]],
    strata: list[str],
    cuts: dict[str, tuple[str, Column]],
    digits: int = PASS_DIGITS,
    ordered: int = ORDERED_ROWS,
) -> DataFrame:
    """Boundaries of many cuts in several ranks, found together.

    ``sources`` are tables with the ``strata`` columns, each with the ranks its rows take part in: a name and an order key, a
    unique string that starts with a uniform hex rank (null: not in that rank). ``cuts`` has, per cut, a rank and the number
    of its rows up to the cut, an expression over ``n_<rank>``, the stratum's rows in each rank.

    The first pass counts all ranks by their leading digits; every further one narrows the buckets that hold a cut by
    ``digits`` more, until they have at most ``ordered`` rows. Only those are ordered. Returns a written table with one row
    per stratum: its columns, ``n_<rank>``, and ``cut_<name>``, null where the number is null, below 1 or beyond the rank.
    A stratum in which no cut is found has no row.
    """
    ranks = sorted({rank for _, own in sources for rank in own})
    totals = [f"n_{rank}" for rank in ranks]

    def entries(width: int) -> DataFrame:
        parts = []
        for rows, own in sources:
            taken = F.explode(F.array(*[F.struct(F.lit(rank).alias("_rank"), order.alias("_order")) for rank, order in own.items()]))
            parts.append(rows.select(*strata, taken.alias("_entry")).select(*strata, "_entry.*"))
        return reduce(DataFrame.unionByName, parts).where("_order is not null").withColumn("_bucket", F.substring("_order", 1, width))

    place = [*strata, "_rank", "_bucket"]
    counted = entries(digits).groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
    # At most 16**digits rows per stratum and rank in a window.
    counted = counted.withColumns({
        f"n_{rank}": F.sum(F.when(F.col("_rank") == rank, F.col("_n")).otherwise(0)).over(W.partitionBy(*strata)) for rank in ranks
    })
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("cut"), F.when(F.col("_rank") == rank, number.cast("long")).alias("_need"))
        for name, (rank, number) in cuts.items()
    ]))
    held = materialize(_crossed(
        counted.withColumn("_upto", F.sum("_n").over(W.partitionBy(*strata, "_rank").orderBy("_bucket")))
        .withColumn("_cut", wanted).select("*", "_cut.*"), [*place, *totals],
    ))
    width = digits
    while held.where(F.col("_n") > ordered).take(1):
        # Every digit of the rank is used before equal keys are given up on.
        if width >= 64:
            break
        inside = join_safe(entries(width), held.select(*place).distinct(), place, "left_semi").withColumn("_parent", F.col("_bucket"))
        width += digits
        finer = inside.groupBy(*strata, "_rank", "_parent", F.substring("_order", 1, width).alias("_next")).agg(
            F.count(F.lit(1)).alias("_n")
        ).withColumn("_upto", F.sum("_n").over(W.partitionBy(*strata, "_rank", "_parent").orderBy("_next")))
        above = held.drop("_n").withColumnRenamed("_bucket", "_parent")
        held = materialize(_crossed(
            join_safe(finer, above, [*strata, "_rank", "_parent"]).withColumn("_bucket", F.col("_next")), [*place, *totals],
        ))
    run = W.partitionBy(*strata, "cut").orderBy("_order")
    found = join_safe(entries(width), held, place).withColumn("_run", F.row_number().over(run)).where("_run = _need")
    return materialize(found.groupBy(*strata).agg(
        *[F.max(n).alias(n) for n in totals],
        *[F.max(F.when(F.col("cut") == name, F.col("_order"))).alias(f"cut_{name}") for name in cuts],
    ))


def _crossed(counted: DataFrame, keep: list[str]) -> DataFrame:
    """The bucket of each cut, with the number of its rows that are up to the cut."""
    before = F.col("_upto") - F.col("_n")
    return counted.where((F.col("_need") > before) & (F.col("_need") <= F.col("_upto"))).select(
        *keep, "cut", (F.col("_need") - before).alias("_need"), "_n"
    )

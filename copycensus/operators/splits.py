"""Class-stratified and group-indivisible splits, and their constraints.

A split is a comparison of each row's hash rank with per-class boundaries, so
the rows themselves are never shuffled or sorted.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copycensus.functions.identity import order_key, stable_rank
from copycensus.operators.ranking import boundaries, boundaries_wide
from copycensus.session import join_groups, join_safe, materialize

PARTITIONS = ("fitting", "development", "evaluation")


def rank_order(seed: int, purpose: str | None = None) -> Column:
    return order_key(stable_rank(seed, F.col("sample_id"), purpose), F.col("sample_id"))


def fail_if_any(bad: DataFrame, message: str, label: str = "class_label") -> None:
    found = [r[label] for r in bad.select(label).take(3)]
    if found:
        raise ValueError(f"{message}: {', '.join(map(str, found))}")


def class_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("class_label").agg(F.count(F.lit(1)).alias("class_size"))


def rounded_share(n: Column, share: float) -> Column:
    """A share of ``n``, halves to even, in decimals: as doubles 45 * 0.7 is just below 31.5."""
    return F.bround(n.cast("decimal(19,0)") * F.lit(Decimal(str(share)))).cast("long")


def shares(n: Column, fit: float, development: float, clamped: bool = False, decimals: bool = True) -> tuple[Column, Column]:
    """Fitting and development rows among ``n``; ``clamped`` leaves one row to each partition, without ``decimals`` products are doubles."""
    if not (0 < fit < 1 and 0 < development < 1 and fit + development < 1):
        raise ValueError("Both shares must be positive and leave a rest for evaluation.")
    n_fit, n_dev = (rounded_share(n, s) if decimals else F.bround(n * F.lit(s)).cast("long") for s in (fit, development))
    if clamped:
        one = F.lit(1).cast("long")
        n_fit = F.greatest(one, F.least(n_fit, n - 2))
        n_dev = F.greatest(one, F.least(n_dev, n - n_fit - 1))
    return n_fit, n_dev


def allocate(sizes: DataFrame, fit: float, development: float, clamped: bool = False, decimals: bool = False) -> DataFrame:
    """Rows per partition from class sizes, rounding halves to even; products are doubles, as in the reference, or ``decimals``, as in SQL.

    Strict allocation leaves the residual to evaluation and fails on an empty
    partition; clamped allocation keeps one row in each partition.
    """
    n = F.col("class_size")
    n_fit, n_dev = shares(n, fit, development, clamped, decimals)
    table = (
        sizes.withColumn("n_fit", n_fit).withColumn("n_dev", n_dev)
        .withColumn("n_eval", n - F.col("n_fit") - F.col("n_dev"))
    )
    fail_if_any(
        table.where(F.least("n_fit", "n_dev", "n_eval") < 1),
        "Too few rows to fill all three partitions in class",
    )
    return table


def cut_targets(table: DataFrame, cuts: dict[str, Column]) -> DataFrame:
    """Long (class, cut, target) form of per-class positions; zero targets are left out."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(name).alias("cut"), target.cast("long").alias("target")) for name, target in cuts.items()
    ])).alias("c")
    return table.select("class_label", pairs).select("class_label", "c.*").where("target >= 1")


def first_ranked(rows: DataFrame, order: Column, targets, cuts: list[str]) -> DataFrame:
    """Rows with one boolean per cut: is the row within the first ``target`` of its class?"""
    keyed = rows.withColumn("_order", order)
    wide = boundaries_wide(boundaries(keyed, ["class_label"], "_order", targets), ["class_label"], cuts)
    joined = join_safe(keyed, wide, ["class_label"], "left")
    return joined.withColumns({
        f"within_{c}": F.coalesce(F.col("_order") <= F.col(f"_cut_{c}"), F.lit(False)) for c in cuts
    }).drop("_order", *[f"_cut_{c}" for c in cuts])


def stratified_split(
    rows: DataFrame, fit: float = 0.7, development: float = 0.2, seed: int = 1401, clamped: bool = False
) -> DataFrame:
    """Assign every row of each class to fitting, development or evaluation."""

    def targets(totals: DataFrame) -> DataFrame:
        sizes = allocate(totals.withColumnRenamed("total", "class_size"), fit, development, clamped, decimals=True)
        return cut_targets(sizes, {"fit": F.col("n_fit"), "dev": F.col("n_fit") + F.col("n_dev")})

    marked = first_ranked(rows, rank_order(seed), targets, ["fit", "dev"])
    partition = (
        F.when(F.col("within_fit"), "fitting").when(F.col("within_dev"), "development").otherwise("evaluation")
    )
    return marked.withColumn("partition", partition).drop("within_fit", "within_dev")


def two_way_split(rows: DataFrame, test: float = 0.2, seed: int = 1406, stratify: bool = True) -> DataFrame:
    """Stratified train/val split, unstratified if a class is too small to be stratified."""
    sizes = materialize(class_sizes(rows))
    if stratify and sizes.where("class_size < 2").take(1):
        stratify = False
    strata = rows if stratify else rows.withColumn("_label", F.col("class_label")).withColumn(
        "class_label", F.lit("")
    )
    sizes = sizes if stratify else class_sizes(strata)
    n = F.col("class_size")
    targets = cut_targets(sizes, {"train": n - F.ceil(n.cast("decimal(19,0)") * F.lit(Decimal(str(test)))).cast("long")})
    marked = first_ranked(strata, rank_order(seed), targets, ["train"])
    if not stratify:
        marked = marked.withColumn("class_label", F.col("_label")).drop("_label")
    return marked.withColumn("partition", F.when(F.col("within_train"), "train").otherwise("val")).drop(
        "within_train"
    )


def group_development_split(
    rows: DataFrame, key: str = "input_sha256", fraction: float = 0.2, seed: int = 1406,
    train: str = "train", evaluation: str = "val", strict: bool = True,
) -> DataFrame:
    """Reserve whole identity groups of training rows for development.

    Groups lying wholly in training are taken in hash order until a class
    reaches its target; the group that crosses the target is taken too.
    ``strict`` fails on a group of several labels, on a class that cannot reach
    its target and on one that would lose all training rows. Otherwise a group
    has the label of its first labelled row by id (shorter ids first), a class
    gives all groups it has, and rows without a key or a label stay in fitting.
    """
    is_train = F.col("original_split") == train
    by_label = materialize(rows.groupBy(key, "class_label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_train).alias("n_train"),
        F.min(F.struct(F.length("sample_id"), "sample_id")).alias("first"),
    ))
    groups = materialize(
        by_label.groupBy(key).agg(
            F.sum("n").alias("size"), F.sum("n_train").alias("n_train"),
            F.count(F.lit(1)).alias("labels"),
            F.min_by("class_label", F.when(F.col("class_label").isNotNull(), F.col("first"))).alias("class_label"),
        ).withColumn("order", order_key(stable_rank(seed, F.col(key)), F.col(key)))
    )
    if strict and groups.where("labels > 1").take(1):
        raise ValueError("An identity group carries more than one label; settle that before splitting.")
    # Of the rows' own labels: a group of several counts for each.
    train_sizes = by_label.groupBy("class_label").agg(F.sum("n_train").alias("n_train"))
    targets = materialize(train_sizes.select(
        "class_label", "n_train", F.lit("dev").alias("cut"),
        F.greatest(F.lit(1).cast("long"), rounded_share(F.col("n_train"), fraction)).alias("target"),
    ))
    whole = F.col("size") == F.col("n_train")
    if not strict:
        whole &= F.col(key).isNotNull() & F.col("class_label").isNotNull()
    eligible = groups.where(whole)
    found = materialize(boundaries(
        eligible.select("class_label", "order", "size"), ["class_label"], "order",
        targets.select("class_label", "cut", "target"), weight="size",
    ))
    if strict:
        fail_if_any(
            join_safe(targets, found.drop("cut"), ["class_label"], "left_anti"),
            "Insufficient training-only groups for development in class",
        )
        fail_if_any(
            join_safe(targets, found.drop("cut"), ["class_label"]).where("reached >= n_train"),
            "Development would take every training row of class",
        )
    cuts = found.select("class_label", "boundary")
    # A class that does not reach its target has no boundary.
    within = F.col("boundary").isNull() | (F.col("order") <= F.col("boundary"))
    chosen = join_safe(groups, cuts, ["class_label"], "left").select(key, "size", (whole & within).alias("chosen"))
    marked = join_groups(rows, materialize(chosen), [key], "size").drop("size")
    partition = (
        F.when(F.col("original_split") == evaluation, "evaluation")
        .when(F.col("chosen"), "development").otherwise("fitting")
    )
    return marked.withColumn("partition", partition).drop("chosen")


def _check(name: str, table: DataFrame, count: Column) -> DataFrame:
    return table.groupBy().agg(F.coalesce(count, F.lit(0)).cast("long").alias("violations")).select(
        F.lit(name).alias("check"), "violations"
    )


def split_violations(
    manifest: DataFrame, keys: list[str] | None = None, evaluation_split: str | None = None,
    disjoint_group: str | None = None, expected_rows: int | None = None, expected_classes: int | None = None,
    splits: list[str] | None = None,
) -> DataFrame:
    """One row per constraint with the number of violations; all zero means valid.

    ``keys`` must not occur both in development and elsewhere; with
    ``evaluation_split`` the evaluation partition must be that source split;
    ``disjoint_group`` may not repeat at all.
    """
    ids = manifest.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("partition").isin(*PARTITIONS)
    classes = manifest.where(known).groupBy("class_label").agg(
        *[F.max((F.col("partition") == p).cast("int")).alias(p) for p in PARTITIONS],
        F.count(F.lit(1)).alias("n"),
    )
    checks = [
        _check("repeated_sample_ids", ids, F.sum(F.col("n") - 1)),
        _check("unknown_partition", manifest, F.count_if(~known)),
        _check("class_missing_from_partition", classes, F.sum(3 - F.col("fitting") - F.col("development") - F.col("evaluation"))),
    ]
    if evaluation_split:
        moved = (F.col("original_split") == evaluation_split) != (F.col("partition") == "evaluation")
        checks.append(_check("evaluation_population_changed", manifest, F.count_if(moved)))
    if splits:
        checks.append(_check("unexpected_source_split", manifest, F.count_if(~F.col("original_split").isin(*splits))))
    for key in keys or []:
        shared = manifest.groupBy(key).agg(
            F.count_if(F.col("partition") == "development").alias("dev"),
            F.count_if(F.col("partition") != "development").alias("other"),
        )
        checks.append(_check(f"development_overlap_{key}", shared, F.sum(F.when(F.col("other") > 0, F.col("dev")))))
    if disjoint_group:
        groups = manifest.groupBy(disjoint_group).agg(F.count(F.lit(1)).alias("n"))
        checks.append(_check("repeated_duplicate_group", groups, F.sum(F.col("n") - 1)))
    if expected_rows is not None:
        checks.append(_check("row_count_differs", classes, F.abs(F.coalesce(F.sum("n"), F.lit(0)) - expected_rows)))
    if expected_classes is not None:
        checks.append(_check("class_count_differs", classes, F.abs(F.count(F.lit(1)) - expected_classes)))
    return reduce(DataFrame.unionByName, checks)


def require_valid(violations: DataFrame) -> None:
    found = [f"{r['check']}={r['violations']}" for r in violations.where("violations > 0").collect()]
    if found:
        raise ValueError("Invalid manifest: " + ", ".join(found))


def count_parity(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Strata whose row counts differ between two tables."""
    a = left.groupBy(*by).agg(F.count(F.lit(1)).alias("left_rows"))
    b = right.groupBy(*by).agg(F.count(F.lit(1)).alias("right_rows"))
    return a.join(b, by, "full").na.fill(0, ["left_rows", "right_rows"]).where("left_rows != right_rows")

"""Paired conditions: full, cleaned of exposure, and size-matched random control."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copycensus.operators.ranking import ORDERED_ROWS, rank_cuts
from copycensus.operators.splits import (
    PARTITIONS, count_parity, cut_targets, fail_if_any, first_ranked, rank_order, shares,
)
from copycensus.session import join_groups, join_safe, materialize


def paired_conditions(
    manifest: DataFrame,
    identity_key: str = "input_sha256",
    held_out: tuple[str, ...] = ("development", "evaluation"),
    seed: int = 1402,
    require_exposure: bool = True,
) -> DataFrame:
    """Mark each row's membership of the three conditions.

    ``in_clean`` drops every fitting row whose identity occurs in a held-out
    partition, whatever its label. ``in_control`` drops as many fitting rows of
    each class by hash rank. Held-out rows belong to every condition.
    ``matches_<partition>`` say where a fitting row's identity recurs.
    """
    counts = [F.count_if(F.col("partition") == p).alias(f"_{p}") for p in PARTITIONS]
    groups = materialize(
        manifest.groupBy(identity_key).agg(*counts, F.count(F.lit(1)).alias("_size"))
    )
    fitting = F.col("partition") == "fitting"
    exposed = reduce(lambda a, b: a | b, [F.col(f"_{p}") > 0 for p in held_out])
    marked = join_groups(manifest, groups, [identity_key], "_size").withColumns({
        "exposed": fitting & exposed,
        "matches_development": fitting & (F.col("_development") > 0),
        "matches_evaluation": fitting & (F.col("_evaluation") > 0),
    }).drop("_size", *[f"_{p}" for p in PARTITIONS])
    marked = materialize(marked)
    removal = materialize(marked.where(fitting).groupBy("class_label").agg(
        F.count(F.lit(1)).alias("fitting"), F.count_if("exposed").alias("need")
    ))
    state = removal.agg(
        F.count_if(F.expr("need > 0 and need >= fitting")).alias("exhausted"), F.sum("need").alias("need")
    ).first()
    if state["exhausted"]:
        fail_if_any(removal.where("need > 0 and need >= fitting"), "Removing exposed rows exhausts class")
    if require_exposure and not state["need"]:
        raise ValueError("No fitting row recurs in a held-out partition; nothing to clean.")
    targets = cut_targets(removal, {"drop": F.col("need")})
    dropped = first_ranked(marked.where(fitting), rank_order(seed), targets, ["drop"])
    held = marked.where(~fitting).withColumn("within_drop", F.lit(False))
    return dropped.unionByName(held).withColumns({
        "in_clean": ~F.col("exposed"), "in_control": ~F.col("within_drop"),
    }).drop("within_drop")


def condition_violations(paired: DataFrame, identity_key: str, held_out: tuple[str, ...]) -> DataFrame:
    """Kept identities that recur in a held-out partition, and classes whose control size differs."""
    fitting = F.col("partition") == "fitting"
    keys = paired.groupBy(identity_key).agg(
        F.count_if(fitting & F.col("in_clean")).alias("kept"),
        F.count_if(F.col("partition").isin(*held_out)).alias("held"),
    )
    sizes = paired.where(fitting).groupBy("class_label").agg(
        F.count_if("in_clean").alias("clean"), F.count_if("in_control").alias("control")
    )
    return keys.groupBy().agg(
        F.sum(F.when(F.col("held") > 0, F.col("kept")).otherwise(0)).alias("violations")
    ).select(F.lit("clean_retains_held_out_identity").alias("check"), "violations").unionByName(
        sizes.groupBy().agg(F.count_if(F.col("clean") != F.col("control")).alias("violations")).select(
            F.lit("control_class_size_differs").alias("check"), "violations"
        )
    )


def condition_rows(paired: DataFrame, keep: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """Long form: one row per (condition, sample)."""
    names = names or {"full": "true", "clean_exact": "in_clean", "random_control": "in_control"}
    member = F.array_compact(F.array(*[
        F.when(F.expr(flag), F.lit(name)) for name, flag in names.items()
    ]))
    return paired.select(F.explode(member).alias("condition"), *keep)


def restrict_classes(full: DataFrame, clean: DataFrame, strict: bool = True) -> DataFrame:
    """Rows of ``full`` whose class occurs in ``clean``; the clean label space must be a subset."""
    clean_labels = materialize(clean.groupBy("class_label").agg(F.count(F.lit(1)).alias("n")).select("class_label"))
    full_labels = materialize(full.groupBy("class_label").agg(F.count(F.lit(1)).alias("n")).select("class_label"))
    fail_if_any(clean_labels.join(full_labels, "class_label", "left_anti"),
                "Classes of the clean table that the full table lacks")
    if strict and not full_labels.join(clean_labels, "class_label", "left_anti").take(1):
        raise ValueError("The clean table must lack at least one class of the full table.")
    return full.join(clean_labels, "class_label", "left_semi")


def matched_subsample(
    source: DataFrame, clean: DataFrame, selection_seed: int = 1404, split_seed: int = 1405
) -> DataFrame:
    """Individual rows of ``source`` with the class and partition counts of ``clean``."""
    wanted = clean.groupBy("class_label").agg(
        *[F.count_if(F.col("partition") == p).alias(f"n_{p}") for p in PARTITIONS],
        F.count(F.lit(1)).alias("needed"),
    )
    available = source.groupBy("class_label").agg(F.count(F.lit(1)).alias("available"))
    targets = materialize(wanted.join(available, "class_label", "left").na.fill(0, ["available"]))
    fail_if_any(targets.where("needed > available"), "Not enough source rows in class")
    chosen = materialize(
        first_ranked(
            source.drop("partition"), rank_order(selection_seed, "select"),
            cut_targets(targets, {"select": F.col("needed")}), ["select"],
        ).where("within_select").drop("within_select")
    )
    marked = first_ranked(chosen, rank_order(split_seed, "split"), cut_targets(targets, {
        "fit": F.col("n_fitting"), "dev": F.col("n_fitting") + F.col("n_development"),
    }), ["fit", "dev"])
    return marked.withColumn(
        "partition",
        F.when(F.col("within_fit"), "fitting").when(F.col("within_dev"), "development").otherwise("evaluation"),
    ).drop("within_fit", "within_dev")


def require_parity(control: DataFrame, clean: DataFrame) -> None:
    fail_if_any(count_parity(control, clean, ["class_label", "partition"]), "Class counts differ")


#: The conditions of ``group_conditions``, in order.
GROUP_CONDITIONS = ("full_all", "full", "clean_consensus", "random_subsample")


def group_conditions(
    rows: DataFrame, groups: DataFrame, minimum: int, seeds: tuple[int, int, int] = (1401, 1404, 1405),
    fit: float = 0.7, development: float = 0.2, ordered: int = ORDERED_ROWS,
) -> DataFrame:
    """``rows`` with one column per condition: the row's partition in it, or null where it is no member.

    ``full_all`` splits every row; ``clean_consensus`` the representatives of pure ``groups`` (of ``dedup.duplicate_groups``),
    in classes of at least ``minimum`` of them; ``full`` is ``full_all`` in those classes; ``random_subsample`` takes as many
    individual rows of each as are clean, and splits them alike. ``seeds`` are those of both splits, of the selection and of
    the subsample's split.

    No row is copied: the cuts of all ranks come from two rounds of ``rank_cuts``, as the subsample's split ranks what the
    first round selects. Rows of a null class belong to ``full_all`` only, rows without an id to nothing. A class too small
    for three partitions is an error.
    """
    split_seed, selection_seed, resplit_seed = seeds
    split, select, resplit = rank_order(split_seed), rank_order(selection_seed, "select"), rank_order(resplit_seed, "split")
    label = F.get("classes", F.lit(0))
    pure = groups.where("group_class_count = 1").select(
        label.alias("class_label"), F.col("representative_sample_id").alias("sample_id")
    )
    # A representative without a label of its own stands for no class.
    unlabelled = rows.where(F.col("class_label").isNull()).select("sample_id")
    pure = pure.join(unlabelled, "sample_id", "left_anti")
    n_all, n_clean, n_split = F.col("n_all"), F.col("n_clean"), F.col("n_split")
    eligible = (n_clean >= minimum) & F.col("class_label").isNotNull()
    whole = _checked(n_all, *shares(n_all, fit, development))
    clean = _checked(n_clean, *shares(n_clean, fit, development, clamped=True))
    taken = shares(n_split, fit, development, clamped=True)
    first = rank_cuts([(rows, {"all": split, "select": select}), (pure, {"clean": split})], ["class_label"], {
        "all_fit": ("all", whole[0]), "all_dev": ("all", whole[1]),
        "clean_fit": ("clean", F.when(eligible, clean[0])), "clean_dev": ("clean", F.when(eligible, clean[1])),
        "select": ("select", F.when(eligible, n_clean)),
    }, ordered=ordered)
    # Ids occur once on both sides, so this join has no hot key.
    clean_ids = pure.select(F.col("sample_id").alias("_clean_id"))
    marked = join_safe(rows, first, ["class_label"], "left")
    chosen = marked.where(eligible & (select <= F.col("cut_select")))
    second = rank_cuts([(chosen.select(*rows.columns), {"split": resplit})], ["class_label"], {
        "sub_fit": ("split", taken[0]), "sub_dev": ("split", taken[0] + taken[1]),
    }, ordered=ordered)
    marked = join_safe(marked, second, ["class_label"], "left")
    marked = marked.join(clean_ids, F.col("sample_id") == F.col("_clean_id"), "left")
    everything = F.when(split.isNotNull(), _partition(split, "all"))
    return marked.select(
        *rows.columns, everything.alias("full_all"), F.when(eligible, everything).alias("full"),
        F.when(eligible & F.col("_clean_id").isNotNull(), _partition(split, "clean")).alias("clean_consensus"),
        F.when(eligible & (select <= F.col("cut_select")), _partition(resplit, "sub")).alias("random_subsample"),
    )


def _checked(n: Column, n_fit: Column, n_dev: Column) -> tuple[Column, Column]:
    """Both cuts of a split; an error where a class with rows has none for a partition."""
    empty = (n > 0) & (F.least(n_fit, n_dev, n - n_fit - n_dev) < 1)
    message = F.concat(F.lit("Too few rows to fill all three partitions in class: "), F.coalesce("class_label", F.lit("null")))
    return F.when(empty, F.raise_error(message).cast("long")).otherwise(n_fit), n_fit + n_dev


def _partition(order: Column, cut: str) -> Column:
    return F.when(order <= F.col(f"cut_{cut}_fit"), "fitting").when(order <= F.col(f"cut_{cut}_dev"), "development").otherwise("evaluation")

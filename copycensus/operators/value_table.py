"""The value table and every audit summary that is an aggregate of it.

One row per (method, value, class_label) with conditional row counts. A value
shared by a third of the corpus is one row per class here, so nothing after
the first partial aggregation depends on how large a group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def split_counts(train: str = "train", evaluation: str = "val") -> dict[str, Column]:
    return {
        "n_train": F.col("original_split") == train,
        "n_eval": F.col("original_split") == evaluation,
    }


def partition_counts() -> dict[str, Column]:
    return {
        f"n_{name}": F.col("partition") == name
        for name in ("fitting", "development", "evaluation")
    }


def value_table(
    rows: DataFrame,
    methods: list[str],
    counts: dict[str, Column] | None = None,
    by: list[str] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Melt the identity columns and count rows per (by, method, value, class).

    With ``weight``, each row stands for that many samples.
    """
    by = by or []
    load = [weight] if weight else []
    flags = {name: flag.cast("long") for name, flag in (counts or {}).items()}
    narrow = rows.select(*by, "class_label", *load, *methods, *[c.alias(n) for n, c in flags.items()])
    melted = narrow.unpivot([*by, "class_label", *load, *flags], methods, "method", "value")
    return melted.groupBy(*by, "method", "value", "class_label").agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("n"), *[F.sum(name).alias(name) for name in flags]
    )


def per_value(values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Group size and number of classes per (by, method, value)."""
    return values.groupBy(*(by or []), "method", "value").agg(
        F.sum("n").alias("size"), F.count(F.lit(1)).alias("class_count")
    )


def global_summary(values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Redundancy per method over the whole corpus."""
    size, mixed = F.col("size"), F.col("class_count") > 1
    return (
        per_value(values, by)
        .groupBy(*(by or []), "method")
        .agg(
            F.sum(size).alias("images"),
            F.count(F.lit(1)).alias("distinct_groups"),
            F.count_if(size > 1).alias("nonsingleton_groups"),
            F.sum(F.when(size > 1, size).otherwise(0)).alias("images_in_nonsingleton_groups"),
            F.count_if(mixed).alias("mixed_label_groups"),
            F.sum(F.when(mixed, size).otherwise(0)).alias("images_in_mixed_label_groups"),
        )
        .withColumn("excess_copies", F.col("images") - F.col("distinct_groups"))
        .withColumn("redundancy_fraction", F.col("excess_copies") / F.col("images"))
    )


def _within_value(by: list[str] | None = None) -> W:
    # At most one row per class: the value table is aggregated before this.
    return W.partitionBy(*(by or []), "method", "value")


def cross_split_overlap(values: DataFrame) -> DataFrame:
    """Evaluation rows whose value occurs in training, with label agreement.

    The two label flags are independent. No evaluation rows, no result rows.
    """
    trained = F.sum("n_train").over(_within_value())
    evaluated = F.col("n_eval")
    return (
        values.withColumn("trained", trained)
        .groupBy("method")
        .agg(
            F.sum("n_train").alias("train_images"),
            F.sum(evaluated).alias("evaluation_images"),
            F.sum(F.when(F.col("trained") > 0, evaluated).otherwise(0)).alias("evaluation_matched"),
            F.sum(F.when(F.col("n_train") > 0, evaluated).otherwise(0)).alias("same_label_matched"),
            F.sum(F.when(F.col("trained") > F.col("n_train"), evaluated).otherwise(0)).alias(
                "other_label_matched"
            ),
        )
        .where(F.col("evaluation_images") > 0)
        .withColumn(
            "evaluation_overlap_fraction", F.col("evaluation_matched") / F.col("evaluation_images")
        )
    )


def per_class_summary(
    values: DataFrame, methods: list[str], consensus: str, minimum_groups: int
) -> DataFrame:
    """Distinct values per method inside each class; mixed groups are judged globally."""
    is_tuple = F.col("method") == consensus
    groups = [F.count_if(F.col("method") == m).alias(f"{m}_groups") for m in methods]
    return (
        values.withColumn("class_count", F.count(F.lit(1)).over(_within_value()))
        .groupBy("class_label")
        .agg(
            F.sum(F.when(is_tuple, F.col("n")).otherwise(0)).alias("original_images"),
            *groups,
            F.sum(F.when(is_tuple & (F.col("class_count") > 1), F.col("n")).otherwise(0)).alias(
                "images_in_mixed_label_consensus_groups"
            ),
        )
        .withColumn("consensus_removed_excess", F.col("original_images") - F.col(f"{consensus}_groups"))
        .withColumn(
            "consensus_removed_percent",
            100 * F.col("consensus_removed_excess") / F.col("original_images"),
        )
        .withColumn(
            "eligible_at_minimum_groups",
            (F.col(f"{consensus}_groups") >= minimum_groups).cast("int"),
        )
    )


def exact_census(values: DataFrame) -> DataFrame:
    """Unique values, excess copies per split and evaluation rows matched in training."""
    totals = values.groupBy("method", "value").agg(
        F.sum("n_train").alias("t"), F.sum("n_eval").alias("e")
    )
    return totals.groupBy("method").agg(
        F.count(F.lit(1)).alias("unique_values"),
        (F.sum("t") - F.count_if(F.col("t") > 0)).alias("train_excess"),
        (F.sum("e") - F.count_if(F.col("e") > 0)).alias("evaluation_excess"),
        F.sum(F.when(F.col("t") > 0, F.col("e")).otherwise(0)).alias("evaluation_matched"),
    )


def method_class_overlap(values: DataFrame) -> DataFrame:
    """Per (method, class): training rows and groups, evaluation rows and matches with any label."""
    return (
        values.withColumn("trained", F.sum("n_train").over(_within_value()))
        .groupBy("method", "class_label")
        .agg(
            F.sum("n_train").alias("train_samples"),
            F.count_if(F.col("n_train") > 0).alias("train_unique_groups"),
            F.sum("n_eval").alias("eval_samples"),
            F.sum(F.when(F.col("trained") > 0, F.col("n_eval")).otherwise(0)).alias(
                "eval_matched_samples"
            ),
        )
    )


def matched_by_class(values: DataFrame, method: str) -> DataFrame:
    """Classes with evaluation rows matched in training under one method."""
    return (
        method_class_overlap(values.where(F.col("method") == method))
        .where(F.col("eval_matched_samples") > 0)
        .select("class_label", "eval_matched_samples")
    )


def overlap_by_class_wide(overlap: DataFrame, methods: list[str]) -> DataFrame:
    """One row per class with the matched evaluation rows of several methods side by side."""
    return overlap.groupBy("class_label").agg(
        F.max("eval_samples").alias("eval_samples"),
        *[
            F.max(F.when(F.col("method") == m, F.col("eval_matched_samples"))).alias(f"{m}_matched")
            for m in methods
        ],
    )


def partition_overlap(values: DataFrame) -> DataFrame:
    """Rows of one partition whose value also occurs in another, per identity key."""
    per_key = values.groupBy("method", "value").agg(
        F.sum("n_fitting").alias("f"), F.sum("n_development").alias("d"), F.sum("n_evaluation").alias("e")
    )
    f, d, e = F.col("f"), F.col("d"), F.col("e")
    return per_key.groupBy(F.col("method").alias("identity_key")).agg(
        F.sum(F.when(f > 0, d).otherwise(0)).alias("development_matching_fitting_images"),
        F.sum(F.when(f > 0, e).otherwise(0)).alias("evaluation_matching_fitting_images"),
        F.sum(F.when(d > 0, e).otherwise(0)).alias("evaluation_matching_development_images"),
    )


def class_partition_counts(
    values: DataFrame, keys: list[str], exposure_keys: list[str] | None = None
) -> DataFrame:
    """Rows and distinct identities per class and partition.

    With ``exposure_keys``, also evaluation rows matching any fitting row, of
    whatever class, under those keys.
    """
    parts = ("fitting", "development", "evaluation")
    exposure_keys = exposure_keys or []
    first = F.col("method") == keys[0]
    columns = [
        F.sum(F.when(first, F.col(f"n_{p}")).otherwise(0)).alias(f"{p}_images") for p in parts
    ]
    columns += [
        F.count_if((F.col("method") == key) & (F.col(f"n_{p}") > 0)).alias(f"{p}_{key}_distinct")
        for p in parts
        for key in keys
    ]
    table = values
    if exposure_keys:
        table = values.withColumn("fitted", F.sum("n_fitting").over(_within_value()))
        columns += [
            F.sum(
                F.when((F.col("method") == key) & (F.col("fitted") > 0), F.col("n_evaluation")).otherwise(0)
            ).alias(f"evaluation_{key}_matches_fitting")
            for key in exposure_keys
        ]
    return table.groupBy("class_label").agg(*columns)

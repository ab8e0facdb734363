"""Pair tables and their summaries.

A pair joins a row to the representative of one of its duplicate groups, so
the number of pairs grows with the rows, never with the square of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copycensus.functions.identity import SIGNATURES, key_id
from copycensus.operators.agreement import in_groups
from copycensus.operators.ranking import positions
from copycensus.operators.splits import rank_order
from copycensus.session import join_groups, materialize


def representative_pairs(rows: DataFrame, key: str, seed: int, keep: list[str]) -> DataFrame:
    """Pair each row with its group's representative, or its class's where it has none.

    The class representative stands in when a row is alone in its group or
    represents it; a row that would be paired with itself gives no pair.
    """
    order = rank_order(seed)
    groups = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("first")))
    classes = materialize(
        rows.groupBy("class_label").agg(F.count(F.lit(1)).alias("class_size"), F.min(order).alias("anchor"))
    )
    grouped = join_groups(rows, groups, [key], "size")
    anchored = join_groups(grouped, classes, ["class_label"], "class_size")
    own = key_id(F.col("first"))
    partner = F.when((F.col("size") > 1) & (own != F.col("sample_id")), own).otherwise(key_id(F.col("anchor")))
    left = anchored.withColumn("partner_id", partner).drop("first", "anchor", "size", "class_size")
    columns = ["class_label", "rgb_sha256", *SIGNATURES, *keep]
    # Many rows share a partner: fold the partners to one row each before joining.
    sizes = materialize(left.groupBy("partner_id").agg(F.count(F.lit(1)).alias("pairs")))
    partners = materialize(
        rows.select(F.col("sample_id").alias("partner_id"), *[F.col(c).alias(f"partner_{c}") for c in columns])
        .join(sizes, "partner_id")
    )
    joined = join_groups(left, partners, ["partner_id"], "pairs").where("sample_id != partner_id")
    mask = sum(
        (F.col(s) == F.col(f"partner_{s}")).cast("int") * (1 << i) for i, s in enumerate(SIGNATURES)
    )
    return joined.withColumns({
        "pair_id": F.col("sample_id"),
        "hash_mask": mask,
        "same_class": (F.col("class_label") == F.col("partner_class_label")).cast("int"),
        "exact_content": (F.col("rgb_sha256") == F.col("partner_rgb_sha256")).cast("int"),
    }).withColumns({
        "phash_match": (F.col("hash_mask") >= 4).cast("int"),
        "sample_kind": F.when(F.col("hash_mask") > 0, "candidate").otherwise("nonmatching_control"),
    }).withColumn("stratum", F.concat_ws("|", F.col("hash_mask").cast("string"), "class_label"))


def summary_predicates() -> dict[str, str]:
    return {
        "all_candidates": "sample_kind = 'candidate'",
        "phash_matches": "phash_match = 1",
        "all_three_matches": "hash_mask = 7",
        "all_three_nonidentical": "hash_mask = 7 and exact_content = 0",
        "nonmatching_controls": "sample_kind = 'nonmatching_control'",
    }


def distribution_predicates() -> dict[str, str]:
    return {
        "all_three": "hash_mask = 7",
        "phash_fewer_than_three": "phash_match = 1 and hash_mask != 7",
        "no_hash_match": "sample_kind = 'nonmatching_control'",
    }


def group_medians(rows: DataFrame, group: str, value: str, unique: str) -> DataFrame:
    """Exact median per group, the mean of the middle two for an even count."""
    placed = positions(rows.select(group, value, unique), [group], [value, unique])
    n, p = F.col("group_rows"), F.col("position")
    middle = (p == F.floor((n + 1) / 2)) | (p == F.floor((n + 2) / 2))
    return placed.where(middle).groupBy(group).agg(F.avg(value).alias(f"{value}_median"))


def pair_metric_summary(pairs: DataFrame, difference: str = "difference", similarity: str = "similarity") -> DataFrame:
    """Counts, medians and range of the pair metrics in each (overlapping) group."""
    grouped = materialize(
        in_groups(pairs, summary_predicates(), ["pair_id", "exact_content", difference, similarity])
    )
    counts = grouped.groupBy("pair_group").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("exact_content").alias("exact"),
        F.min(similarity).alias(f"{similarity}_min"), F.max(similarity).alias(f"{similarity}_max"),
    )
    return counts.join(group_medians(grouped, "pair_group", difference, "pair_id"), "pair_group").join(
        group_medians(grouped, "pair_group", similarity, "pair_id"), "pair_group"
    )


def empirical_cdf(pairs: DataFrame, value: str, predicates: dict[str, str] | None = None) -> DataFrame:
    """Each group's values in order with the fraction at or before each position."""
    grouped = in_groups(pairs, predicates or distribution_predicates(), ["pair_id", value])
    placed = positions(grouped, ["pair_group"], [value, "pair_id"])
    return placed.select(
        "pair_group", "position", value, (F.col("position") / F.col("group_rows")).alias("cumulative_fraction")
    )


def stratum_counts(pairs: DataFrame) -> DataFrame:
    """Pairs and distinct strata of each kind of pair."""
    return pairs.groupBy("sample_kind", "stratum").agg(F.count(F.lit(1)).alias("n")).groupBy("sample_kind").agg(
        F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("strata")
    )


def removal_ranking(classes: DataFrame, minimum_groups: int) -> DataFrame:
    """Classes by removed share with the flag the bar chart is coloured by."""
    return classes.select(
        "class_label", "removed_percent",
        F.when(F.col("retained_groups") < minimum_groups, "excluded").otherwise("retained").alias("status"),
    ).orderBy("removed_percent", "class_label")

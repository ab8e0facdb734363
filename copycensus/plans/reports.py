"""Text columns for people, made from the numeric summaries at the last step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Display names of the match methods.
METHOD_NAMES = {
    "file_sha256": "File SHA-256", "rgb_sha256": "Native RGB SHA-256", "ahash": "aHash",
    "dhash": "dHash", "phash": "pHash", "hash_consensus": "Complete tuple",
}


def thousands(column: str) -> Column:
    return F.format_number(F.col(column), 0)


def percent(fraction: Column) -> Column:
    return F.format_string("%.2f%%", 100 * fraction)


def method_name() -> Column:
    names = F.create_map(*[F.lit(x) for pair in METHOD_NAMES.items() for x in pair])
    return F.coalesce(names[F.col("method")], F.col("method"))


def global_report(summary: DataFrame) -> DataFrame:
    return summary.select(
        method_name().alias("method"), *[thousands(c).alias(c) for c in ("distinct_groups", "excess_copies")],
        percent(F.col("redundancy_fraction")).alias("redundancy"), thousands("mixed_label_groups").alias("mixed_label_groups"),
    )


def class_report(classes: DataFrame) -> DataFrame:
    counts = ("original_images", "hash_consensus_groups", "consensus_removed_excess")
    return classes.select(
        "class_label", *[thousands(c).alias(c) for c in counts],
        F.format_string("%.2f%%", F.col("consensus_removed_percent")).alias("removed"),
        F.when(F.col("eligible_at_minimum_groups") == 1, "yes").otherwise("no").alias("eligible"),
    )


def metric_report(summary: DataFrame) -> DataFrame:
    return summary.select(
        "condition", "metric",
        F.format_string("%.2f ± %.2f", F.col("mean_percent"), F.col("sample_sd_pp")).alias("mean_sd"),
    )


def contrast_report(summary: DataFrame) -> DataFrame:
    return summary.select(
        "contrast", "metric", F.format_string("%+.2f", F.col("mean_pp")).alias("mean_pp"),
        F.format_string("[%+.2f, %+.2f]", F.col("ci95_lower_pp"), F.col("ci95_upper_pp")).alias("ci95"),
        "seed_values_pp",
    )


def markdown_lines(report: DataFrame) -> DataFrame:
    """Each row as one line of a Markdown table."""
    cells = F.concat_ws(" | ", *[F.col(f"`{c}`").cast("string") for c in report.columns])
    return report.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))

"""Exposure of held-out rows in the fitting rows of each condition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONDITIONS = {"full": None, "clean_exact": "in_clean", "random_control": "in_control"}


def _fit_flag(flag: str | None) -> Column:
    fitting = F.col("partition") == "fitting"
    return fitting if flag is None else fitting & F.col(flag)


def _key_counts(paired: DataFrame, keys: list[str]) -> DataFrame:
    return paired.groupBy(*keys).agg(
        *[F.count_if(_fit_flag(flag)).alias(f"{name}_fit") for name, flag in CONDITIONS.items()],
        F.count_if(F.col("partition") == "development").alias("dev"),
        F.count_if(F.col("partition") == "evaluation").alias("ev"),
        F.count_if(_fit_flag(None) & F.col("exposed")).alias("removed"),
        F.count_if(_fit_flag(None) & F.col("exposed") & F.col("matches_development")).alias("removed_dev"),
        F.count_if(_fit_flag(None) & F.col("exposed") & F.col("matches_evaluation")).alias("removed_ev"),
    )


def _sum_if(condition: Column, value: str) -> Column:
    return F.sum(F.when(condition, F.col(value)).otherwise(0))


def condition_exposure(paired: DataFrame, identity_key: str) -> DataFrame:
    """Per class: sizes, removals, and held-out rows matching fitting rows of the same class."""
    per_key = _key_counts(paired, ["class_label", identity_key])
    columns = [
        F.sum("dev").alias("development"), F.sum("ev").alias("evaluation"),
        F.sum("removed").alias("removed_exact"),
        F.sum("removed_dev").alias("removed_matching_development"),
        F.sum("removed_ev").alias("removed_matching_evaluation"),
    ]
    for name in CONDITIONS:
        hit = F.col(f"{name}_fit") > 0
        columns += [
            F.sum(f"{name}_fit").alias(f"{name}_fitting"),
            _sum_if(hit, "dev").alias(f"{name}_development_matches"),
            _sum_if(hit, "ev").alias(f"{name}_evaluation_matches"),
        ]
    return per_key.groupBy("class_label").agg(*columns)


def condition_exposure_global(paired: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Per class: evaluation rows matching any fitting row of the condition, for several keys."""
    flags = {
        **{f"{name}_fit": _fit_flag(flag) for name, flag in CONDITIONS.items()},
        "dev": F.col("partition") == "development",
        "ev": F.col("partition") == "evaluation",
        "removed": F.col("exposed"),
    }
    narrow = paired.select("class_label", *keys, *[c.cast("long").alias(n) for n, c in flags.items()])
    per_key = narrow.unpivot(["class_label", *flags], list(keys), "method", "value").groupBy(
        "method", "value", "class_label"
    ).agg(*[F.sum(n).alias(n) for n in flags])
    # At most one row per class and value in each window.
    anywhere = W.partitionBy("method", "value")
    per_key = per_key.withColumns({
        f"{name}_any": F.sum(f"{name}_fit").over(anywhere) for name in CONDITIONS
    })
    first = F.col("method") == next(iter(keys))
    columns = [
        _sum_if(first, "removed").alias("removed_exact"),
        _sum_if(first, "dev").alias("development"),
        _sum_if(first, "ev").alias("evaluation"),
    ]
    for name in CONDITIONS:
        columns.append(_sum_if(first, f"{name}_fit").alias(f"{name}_fitting"))
        columns += [
            _sum_if((F.col("method") == key) & (F.col(f"{name}_any") > 0), "ev").alias(
                f"{name}_evaluation_{suffix}_matches"
            )
            for key, suffix in keys.items()
        ]
    return per_key.groupBy("class_label").agg(*columns)


def removed_attribution(paired: DataFrame) -> DataFrame:
    """Removed fitting rows per class by the partition their identity recurs in."""
    return paired.where("exposed").groupBy("class_label").agg(
        F.count(F.lit(1)).alias("removed_exact"),
        F.count_if("matches_development").alias("removed_matching_development"),
        F.count_if("matches_evaluation").alias("removed_matching_evaluation"),
    )


def class_exposure_report(paired: DataFrame, identity_key: str) -> DataFrame:
    """Pooled redundancy, condition sizes and matched held-out rows per class."""
    per_key = _key_counts(paired, ["class_label", identity_key])
    names = {"full": "full", "clean_exact": "clean", "random_control": "control"}
    columns = [
        (F.sum("full_fit") + F.sum("dev") + F.sum("ev")).alias("pooled_images"),
        F.count(F.lit(1)).alias("pooled_distinct_exact_inputs"),
        *[F.sum(f"{name}_fit").alias(f"{name}_fitting") for name in CONDITIONS],
        F.sum("removed").alias("removed_from_fitting"),
        F.sum("dev").alias("development"), F.sum("ev").alias("evaluation"),
    ]
    for name, short in names.items():
        hit = F.col(f"{name}_fit") > 0
        columns += [
            _sum_if(hit, "ev").alias(f"{short}_evaluation_images_with_fitting_match"),
            _sum_if(hit, "dev").alias(f"{short}_development_images_with_fitting_match"),
        ]
    excess = F.col("pooled_images") - F.col("pooled_distinct_exact_inputs")
    percent = lambda a, b: F.coalesce(F.try_divide(100.0 * a, b), F.lit(0.0))
    return (
        per_key.groupBy("class_label").agg(*columns)
        .withColumn("pooled_excess_exact_copies", excess)
        .withColumn("pooled_exact_redundancy_percent", percent(excess, F.col("pooled_images")))
        .withColumn("fitting_removal_percent", percent(F.col("removed_from_fitting"), F.col("full_fitting")))
    )


def scope_summary(paired: DataFrame, identity_key: str) -> DataFrame:
    """Three rows: the pooled corpus, the cleaned experiment and the random control."""
    total = _key_counts(paired, [identity_key]).groupBy().agg(
        F.count(F.lit(1)).alias("distinct"),
        *[F.sum(f"{name}_fit").alias(name) for name in CONDITIONS],
        F.sum("dev").alias("development"), F.sum("ev").alias("evaluation"), F.sum("removed").alias("removed"),
    )
    held = F.col("development") + F.col("evaluation")
    images = F.col("full") + held
    nothing = F.lit(None).cast("long")

    def scope(name: str, fitting: str, removed: Column, distinct: Column, excess: Column, percent: Column) -> Column:
        return F.struct(
            F.lit(name).alias("scope"), (F.col(fitting) + held).alias("images"),
            distinct.alias("distinct_exact_inputs"), excess.alias("excess_exact_copies"),
            percent.alias("redundancy_percent"), F.col(fitting).alias("fitting"),
            F.col("development").alias("development"), F.col("evaluation").alias("evaluation"),
            removed.alias("removed_from_fitting"),
        )

    rows = F.array(
        scope("pooled_full_dataset", "full", F.lit(0).cast("long"), F.col("distinct"), images - F.col("distinct"),
              F.coalesce(F.try_divide(100.0 * (images - F.col("distinct")), images), F.lit(0.0))),
        scope("experimental_clean_exact_dataset", "clean_exact", F.col("removed"), nothing, nothing,
              F.lit(None).cast("double")),
        scope("random_control_dataset", "random_control", F.col("full") - F.col("random_control"), nothing, nothing,
              F.lit(None).cast("double")),
    )
    return total.select(F.explode(rows).alias("r")).select("r.*")


def reconstruct_check(manifest: DataFrame, full: DataFrame, clean: DataFrame, removed: DataFrame) -> DataFrame:
    """Ids on the wrong side of: clean plus removed = full, full within manifest."""
    sides = [
        df.select("sample_id", *[F.lit(int(i == j)).alias(f"s{j}") for j in range(4)])
        for i, df in enumerate((manifest, full, clean, removed))
    ]
    seen = reduce(DataFrame.unionByName, sides).groupBy("sample_id").agg(
        *[F.max(f"s{j}").alias(n) for j, n in enumerate(("m", "f", "c", "r"))]
    )
    return seen.groupBy().agg(
        F.count_if(F.expr("f = 1 and m = 0")).alias("unknown_samples"),
        F.count_if(F.expr("f = 1 and c = 0 and r = 0")).alias("missing_from_clean_and_removed"),
        F.count_if(F.expr("f = 0 and (c = 1 or r = 1)")).alias("not_in_full"),
        F.count_if(F.expr("c = 1 and r = 1")).alias("both_clean_and_removed"),
    )


def condition_summary(table: DataFrame, names: list[str], key: str = "hash_consensus") -> DataFrame:
    """One row per condition that has rows: classes, sizes, distinct groups and matched held-out rows.

    ``table`` has one row per sample and, per condition, a column with its partition or null. All conditions are counted in
    one pass, by key and by class.
    """
    parts = {"f": "fitting", "d": "development", "e": "evaluation"}
    counts = [F.count_if(F.col(name) == p).alias(f"{name}_{s}") for name in names for s, p in parts.items()]
    counted = table.groupingSets([[F.col(key)], [F.col("class_label")]], F.col(key), F.col("class_label")).agg(
        (F.grouping("class_label") == 1).alias("by_key"), *counts
    )

    def summary(name: str) -> Column:
        f, d, e = (F.when(F.col("by_key"), F.col(f"{name}_{s}")).otherwise(0) for s in parts)
        rows = F.col(f"{name}_f") + F.col(f"{name}_d") + F.col(f"{name}_e")
        return F.struct(
            F.lit(name).alias("condition"), F.sum(f + d + e).alias("images"), F.sum(f).alias("fitting"),
            F.sum(d).alias("development"), F.sum(e).alias("evaluation"),
            F.count_if(F.col("by_key") & (rows > 0)).alias("distinct_consensus_groups"),
            F.sum(F.when(f > 0, d).otherwise(0)).alias("development_images_matching_fitting_group"),
            F.sum(F.when(f > 0, e).otherwise(0)).alias("evaluation_images_matching_fitting_group"),
            F.count_if(~F.col("by_key") & F.col("class_label").isNotNull() & (rows > 0)).alias("classes"),
        ).alias(name)

    one = counted.groupBy().agg(*[summary(name) for name in names])
    return one.select(F.explode(F.array(*names)).alias("r")).select("r.*").where("images > 0")


def condition_class_counts(table: DataFrame, names: list[str]) -> DataFrame:
    """Rows per class for every condition and partition; zero where a class is absent."""
    return table.groupBy("class_label").agg(*[
        F.count_if(F.col(name) == p).alias(f"{name}_{p}")
        for name in names
        for p in ("fitting", "development", "evaluation")
    ])


def exposure_fractions(summary: DataFrame) -> DataFrame:
    """Share of evaluation rows that match a fitting group, per condition."""
    matched = F.col("evaluation_images_matching_fitting_group")
    return summary.select(
        "condition", "images", "fitting", "development", "evaluation", "distinct_consensus_groups",
        matched.alias("evaluation_matched"),
        F.try_divide(matched, F.col("evaluation")).alias("evaluation_matched_fraction"),
    )

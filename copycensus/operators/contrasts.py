"""Seed-paired contrasts between conditions and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copycensus.functions.stats import t_critical_95
from copycensus.operators.scores import METRICS

# Two-decimal-table critical values by number of paired seeds.
TABULATED_T = {2: 12.706, 3: 4.303, 4: 3.182, 5: 2.776}


def results_union(runs: DataFrame) -> DataFrame:
    """Run rows without the map of artifact digests."""
    return runs.drop("artifacts_sha256")


def seed_contrasts(
    results: DataFrame, pairs: dict[str, tuple[str, str]], by: list[str] | None = None,
    metrics: tuple[str, ...] = METRICS, required: list[str] | None = None,
) -> DataFrame:
    """Differences in percentage points for every seed that has all conditions."""
    by = by or []
    needed = required or sorted({c for pair in pairs.values() for c in pair})
    cells = [
        F.max(F.when(F.col("condition") == c, F.col(m))).alias(f"_{i}_{m}")
        for i, c in enumerate(needed) for m in metrics
    ]
    present = [F.max((F.col("condition") == c).cast("int")).alias(f"_has_{i}") for i, c in enumerate(needed)]
    wide = results.where(F.col("condition").isin(needed)).groupBy(*by, "seed").agg(*cells, *present)
    for i in range(len(needed)):
        wide = wide.where(F.col(f"_has_{i}") == 1)
    place = {c: i for i, c in enumerate(needed)}
    entries = [
        F.struct(
            F.lit(name).alias("contrast"), F.lit(m).alias("metric"),
            (100 * (F.col(f"_{place[a]}_{m}") - F.col(f"_{place[b]}_{m}"))).alias("difference_pp"),
        )
        for name, (a, b) in pairs.items() for m in metrics
    ]
    return wide.select(*by, "seed", F.explode(F.array(*entries)).alias("e")).select(*by, "seed", "e.*")


def seed_contrasts_wide(contrasts: DataFrame, pairs: list[str], by: list[str] | None = None,
                        metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row per seed with a column per contrast and metric."""
    return contrasts.groupBy(*(by or []), "seed").agg(*[
        F.max(F.when((F.col("contrast") == p) & (F.col("metric") == m), F.col("difference_pp"))).alias(f"{p}_{m}_pp")
        for p in pairs for m in metrics
    ])


def metric_summary(results: DataFrame, by: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Count, mean, sample deviation and range in percent; no deviation for one run."""
    long = results.select(*by, *metrics).unpivot(by, list(metrics), "metric", "value")
    value = 100 * F.col("value")
    return long.groupBy(*by, "metric").agg(
        F.count("value").alias("completed_seeds"), F.avg(value).alias("mean_percent"),
        F.stddev_samp(value).alias("sample_sd_pp"), F.min(value).alias("minimum_percent"),
        F.max(value).alias("maximum_percent"),
    )


def contrast_summary(contrasts: DataFrame, by: list[str] | None = None, critical: str = "exact") -> DataFrame:
    """Mean difference with a 95 % Student interval over seeds.

    One seed gives an interval of no width. ``critical="tabulated"`` uses the
    fixed table and leaves the interval empty outside it.
    """
    by = by or []
    d = F.col("difference_pp")
    table = contrasts.groupBy(*by, "contrast", "metric").agg(
        F.count(d).alias("completed_seeds"), F.avg(d).alias("mean_pp"), F.stddev_samp(d).alias("sample_sd_pp"),
        F.min(d).alias("minimum_pp"), F.max(d).alias("maximum_pp"),
        # One entry per seed.
        F.array_sort(F.collect_list(F.struct("seed", "difference_pp"))).alias("_seeds"),
    )
    n = F.col("completed_seeds")
    if critical == "tabulated":
        t: Column = F.create_map(*[F.lit(x) for pair in TABULATED_T.items() for x in pair])[n.cast("int")]
        half = t * F.col("sample_sd_pp") / F.sqrt(n)
    elif critical == "exact":
        t = t_critical_95((n - 1).cast("long"))
        half = F.when(n < 2, F.lit(0.0)).otherwise(t * F.col("sample_sd_pp") / F.sqrt(n))
    else:
        raise ValueError("critical is 'exact' or 'tabulated'")
    values = F.array_join(
        F.transform("_seeds", lambda s: F.format_string("%d:%.6f", s["seed"], s["difference_pp"])), ";"
    )
    return (
        table.withColumn("_half", half)
        .withColumn("ci95_lower_pp", F.col("mean_pp") - F.col("_half"))
        .withColumn("ci95_upper_pp", F.col("mean_pp") + F.col("_half"))
        .withColumn("seed_values_pp", values)
        .drop("_half", "_seeds")
    )


def class_metric_contrast(class_scores: DataFrame, by: list[str], left: str, right: str, metric: str = "recall") -> DataFrame:
    """Difference of seed means of a class score between two conditions, in points."""
    means = class_scores.groupBy(*by, "class_label").agg(
        *[F.avg(F.when(F.col("condition") == c, F.col(metric))).alias(n) for c, n in ((left, "_l"), (right, "_r"))]
    )
    return means.select(*by, "class_label", (100 * (F.col("_l") - F.col("_r"))).alias(f"{metric}_difference_pp"))


def study_aggregate(results: DataFrame, by: list[str]) -> DataFrame:
    """Mean and deviation of accuracy and macro F1 per study."""
    return results.groupBy(*by).agg(
        F.avg("accuracy").alias("accuracy_mean"), F.stddev_samp("accuracy").alias("accuracy_std"),
        F.avg("macro_f1").alias("macro_f1_mean"), F.stddev_samp("macro_f1").alias("macro_f1_std"),
    )


def contrast_extremes(summary: DataFrame) -> DataFrame:
    """Least and greatest mean of each contrast and metric over the studies, or models, of a ``contrast_summary``."""
    return summary.groupBy("contrast", "metric").agg(
        F.count(F.lit(1)).alias("studies"), F.min("mean_pp").alias("minimum_mean_pp"), F.max("mean_pp").alias("maximum_mean_pp")
    )

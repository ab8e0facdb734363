"""Frozen protocols: build once, write, and verify before every reuse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copycensus.functions.identity import IDENTITY_KEYS, rule_key
from copycensus.operators import dedup, splits, verify
from copycensus.operators import value_table as vt
from copycensus.session import materialize
from copycensus.sources.folders import path_exists
from copycensus.sources.tables import freeze_settings, write_table


def _seal(manifest: DataFrame) -> str:
    return verify.rowset_digest(manifest).first()["digest"]


def reuse_violations(frozen: DataFrame, current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Everything that must hold before a frozen manifest is used again, as (check, violations)."""
    def counted(name: str, df: DataFrame) -> DataFrame:
        return df.groupBy().agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")

    seals = verify.rowset_digest(frozen).select("digest").unionByName(recorded.select("digest"))
    distinct = seals.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    return reduce(DataFrame.unionByName, [
        splits.split_violations(frozen),
        counted("membership_drift", verify.membership_drift(current, frozen)),
        counted("unsafe_paths", verify.unsafe_paths(frozen)),
        counted("content_drift", verify.content_drift(frozen, current)),
        distinct.groupBy().agg((F.count(F.lit(1)) - 1).alias("violations")).select(
            F.lit("manifest_digest").alias("check"), "violations"
        ),
    ])


def frozen_split(
    rows: DataFrame, folder: str, fit: float = 0.7, development: float = 0.2, seed: int = 1401
) -> DataFrame:
    """The stratified split stored in ``folder``, built on first use.

    A later call must bring the same settings and the same files; otherwise it fails.
    """
    spark = rows.sparkSession
    settings = {"fit": fit, "development": development, "seed": seed}
    keys = [k for k in IDENTITY_KEYS if k in rows.columns]
    if path_exists(spark, folder):
        for part in ("settings", "manifest", "seal"):
            if not path_exists(spark, f"{folder}/{part}"):
                raise ValueError(f"Incomplete protocol folder {folder}: no {part}")
        freeze_settings(spark, f"{folder}/settings", settings)
        frozen = spark.read.parquet(f"{folder}/manifest")
        splits.require_valid(reuse_violations(frozen, rows, spark.read.parquet(f"{folder}/seal")))
        return frozen
    manifest = materialize(splits.stratified_split(rows, fit, development, seed))
    splits.require_valid(splits.split_violations(manifest))
    values = materialize(vt.value_table(manifest, keys, vt.partition_counts()))
    write_table(manifest, f"{folder}/manifest")
    write_table(vt.class_partition_counts(values, keys), f"{folder}/class_counts")
    write_table(vt.partition_overlap(values), f"{folder}/split_overlap")
    write_table(verify.snapshot_digest(manifest), f"{folder}/snapshot")
    write_table(verify.rowset_digest(manifest), f"{folder}/seal")
    freeze_settings(spark, f"{folder}/settings", settings)
    return spark.read.parquet(f"{folder}/manifest")


def deduplicate_then_split(
    rows: DataFrame, output: str, rule: str = "exact_input", minimum: int = 3, exclude: bool = False,
    fit: float = 0.7, development: float = 0.2, representative_seed: int = 1403, split_seed: int = 1401,
) -> DataFrame:
    """One representative per group of one label, then a clamped split; writes all tables.

    Returns the metadata row.
    """
    if minimum < 3:
        raise ValueError("A class needs at least 3 groups to fill three partitions")
    spark = rows.sparkSession
    if path_exists(spark, output):
        raise FileExistsError(f"Output already exists: {output}")
    value = rule_key(rule)
    rows = materialize(rows)
    groups = materialize(dedup.duplicate_groups(rows, value, rule, representative_seed))
    dedup.require_pure(rows, value, groups)
    annotated = materialize(dedup.annotate(rows, value, groups).withColumn("dedup_rule", F.lit(rule)))
    kept = dedup.retained(annotated)
    counts = kept.groupBy("class_label").agg(F.count(F.lit(1)).alias("retained_groups"))
    short = dedup.insufficient_classes(counts, minimum, exclude)
    manifest = materialize(splits.stratified_split(
        kept.join(short.select("class_label"), "class_label", "left_anti"), fit, development, split_seed, clamped=True
    ))
    splits.require_valid(splits.split_violations(manifest, disjoint_group="duplicate_group_id"))
    write_table(manifest, f"{output}/manifest")
    write_table(dedup.removed(annotated), f"{output}/removed_duplicates")
    write_table(groups.withColumn("class_label", F.col("classes")[0]).drop("classes"), f"{output}/duplicate_groups")
    write_table(dedup.class_table(annotated, manifest), f"{output}/per_class")
    metadata = protocol_metadata(annotated, manifest, short).withColumns({
        "rule": F.lit(rule), "minimum_groups_per_class": F.lit(minimum), "fit_fraction": F.lit(fit),
        "development_fraction": F.lit(development), "representative_seed": F.lit(representative_seed),
        "split_seed": F.lit(split_seed), "manifest_digest": F.lit(_seal(manifest)),
    })
    write_table(metadata, f"{output}/protocol", fmt="json")
    return metadata


def protocol_metadata(annotated: DataFrame, manifest: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row: sizes before and after deduplication, excluded classes, partition sizes."""
    one = F.lit(1).alias("_one")
    sizes = annotated.groupBy().agg(
        F.count(F.lit(1)).alias("source_images"),
        F.count_if("is_representative").alias("retained_representatives"),
        F.count_if(~F.col("is_representative")).alias("removed_excess_copies"),
    )
    parts = manifest.groupBy("partition").agg(F.count(F.lit(1)).alias("n")).groupBy().agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("partition", "n")))).alias("partition_counts"),
        F.sum("n").alias("split_images"),
    )
    gone = excluded.groupBy().agg(F.array_sort(F.collect_list("class_label")).alias("excluded_classes"))
    return sizes.select("*", one).join(parts.select("*", one), "_one").join(gone.select("*", one), "_one").drop("_one")


def pair_metadata(rows: DataFrame, groups: DataFrame, classes: DataFrame, safe: DataFrame) -> DataFrame:
    """One row: what excluding mixed groups and small classes leaves for the full and clean protocols."""
    one = F.lit(1).alias("_one")
    eligible = F.col("eligible") == 1

    def names(flag: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(flag, F.col("class_label"))))

    mixed = F.col("group_class_count") > 1
    per_group = groups.groupBy().agg(
        F.sum("duplicate_group_size").alias("source_images"),
        F.count_if(mixed).alias("mixed_label_groups_excluded"),
        F.sum(F.when(mixed, F.col("duplicate_group_size")).otherwise(0)).alias("mixed_label_images_excluded"),
    )
    per_class = classes.groupBy().agg(
        names(eligible).alias("eligible_classes"), names(~eligible).alias("excluded_classes")
    )
    members = safe.groupBy().agg(
        F.count(F.lit(1)).alias("safe_full_images"),
        F.count_if(eligible & F.col("is_representative")).alias("clean_representatives"),
        F.count_if(eligible & ~F.col("is_representative")).alias("consensus_excess_removed_from_eligible_safe_pool"),
    )
    return (
        per_group.select("*", one).join(per_class.select("*", one), "_one").join(members.select("*", one), "_one")
        .drop("_one")
    )


def run_tree_audit(
    spark: SparkSession, root: str, conditions: list[str], seeds: list[int],
    history: str | None = None, loss: str = "development_loss", zero_based: bool = False,
    levels: tuple[str, ...] = ("condition", "seed"),
) -> DataFrame:
    """All checks of a tree of finished runs as one table (check, subject, found); empty means pass.

    ``levels`` are the folders down to a run. Those beside condition and seed, such as a study, are groups: each has all
    conditions and seeds, and its runs are paired with one another only.
    """
    from copycensus.operators import scores
    from copycensus.sources import tables

    keys, groups = list(levels), [level for level in levels if level not in ("condition", "seed")]
    runs = materialize(tables.read_runs(spark, root, levels))
    predictions, classes = tables.probabilities(tables.read_run_tables(spark, root, "predictions.csv", levels))
    predictions = materialize(predictions)
    stored = scores.score_violations(
        predictions, runs, tables.read_run_tables(spark, root, "per_class.csv", levels),
        tables.confusion_long(tables.read_run_tables(spark, root, "confusion_matrix.csv", levels), classes, levels), keys, classes,
    )
    subject = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    paired = F.concat_ws("/", *groups, F.col("seed").cast("string"))

    def rows(check: str, df: DataFrame, who, found) -> DataFrame:
        return df.select(F.lit(check).alias("check"), who.alias("subject"), found.cast("string").alias("found"))

    shape = scores.prediction_violations(predictions, keys, classes).where(
        "wrong_shape + nonfinite + unknown_label + not_arg_max > 0"
    )
    starts = verify.paired_start_check(runs, [*groups, "seed"]).where("initial_states != 1")
    parts = [
        rows("run_set", verify.run_completeness(runs, conditions, seeds, groups), subject, F.col("problem")),
        rows("predictions", shape, subject, F.lit("labels or probabilities are invalid")),
        stored.select("check", "subject", F.concat_ws(" ", "field", F.col("stored").cast("string"),
                                                      F.col("recomputed").cast("string")).alias("found")),
        rows("artifact", verify.artifact_drift(runs, tables.run_artifacts(spark, root, levels), keys), subject, F.col("name")),
        rows("initial_state", starts, paired, F.col("initial_states")),
    ]
    if history:
        table = tables.read_run_tables(spark, root, history, levels).withColumns({
            "epoch": F.col("epoch").cast("double").cast("long"), loss: F.col(loss).cast("double"),
        })
        late = scores.epoch_violations(table, runs, keys, loss=loss, zero_based=zero_based)
        parts.append(rows("selected_epoch", late, subject, F.col("best")))
    return reduce(DataFrame.unionByName, parts)

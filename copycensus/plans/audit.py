"""A whole audit: hash, summarise, deduplicate, and write every table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copycensus.functions.identity import MATCH_METHODS
from copycensus.operators import dedup, verify
from copycensus.operators import value_table as vt
from copycensus.operators.splits import fail_if_any
from copycensus.session import materialize
from copycensus.sources import folders
from copycensus.sources.folders import path_exists
from copycensus.sources.tables import output_checksums, write_table


def audit_metadata(rows: DataFrame, groups: DataFrame, classes: DataFrame, minimum: int, seed: int) -> DataFrame:
    """One row of counts, split sizes, small classes and the snapshot digest."""
    one = F.lit(1).alias("_one")
    per_split = rows.groupBy("original_split").agg(F.count(F.lit(1)).alias("n"))
    splits = per_split.groupBy().agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("original_split", "n")))).alias("original_split_counts"),
        F.sum("n").alias("images"),
    )
    labels = classes.groupBy().agg(
        F.count(F.lit(1)).alias("classes"),
        F.array_sort(F.collect_list(F.when(F.col("eligible_at_minimum_groups") == 0, F.col("class_label")))).alias(
            "classes_below_minimum"
        ),
    )
    mixed = F.count_if(F.col("group_class_count") > 1)
    kept = groups.groupBy().agg(
        F.count(F.lit(1)).alias("retained_representatives"),
        (F.sum("duplicate_group_size") - F.count(F.lit(1))).alias("removed_excess_copies"),
        mixed.alias("mixed_label_consensus_groups"),
        (mixed == 0).alias("safe_to_construct_label_preserving_clean_split"),
    )
    snapshot = verify.snapshot_digest(rows).select(F.col("digest").alias("dataset_snapshot_sha256"))
    table = splits.select("*", one)
    for part in (labels, kept, snapshot):
        table = table.join(part.select("*", one), "_one")
    return table.drop("_one").withColumns({
        "status": F.lit("completed"), "minimum_groups_per_class": F.lit(minimum),
        "representative_seed": F.lit(seed), "hash_bits": F.lit(64), "hamming_threshold": F.lit(0),
    })


def run_audit(
    spark: SparkSession, rows: DataFrame, output: str, train: str = "train", evaluation: str = "test",
    minimum_groups: int = 50, seed: int = 1403, fmt: str = "parquet", proofs: dict[str, str] | None = None,
) -> DataFrame:
    """Audit a hashed sample table into a new folder; returns the metadata row.

    ``proofs`` names the payload column of each digest: rows of equal digest are compared by payload before anything is
    counted, groups that differ fail the audit, and the numbers of groups and repeats compared join the metadata. Payload columns
    are not written.
    """
    if path_exists(spark, output):
        raise FileExistsError(f"Output already exists: {output}")
    checks = None
    if proofs:
        checks = materialize(reduce(DataFrame.unionByName, [
            dedup.verify_exact_groups(rows, key, payload).select(F.lit(key).alias("identity"), "*") for key, payload in proofs.items()
        ]))
        fail_if_any(checks.where("groups_that_differ > 0"), "Equal digests with different payloads", "identity")
        rows = rows.drop(*proofs.values())
    rows = materialize(rows)
    methods = list(MATCH_METHODS)
    values = materialize(vt.value_table(rows, methods, vt.split_counts(train, evaluation)))
    classes = materialize(vt.per_class_summary(values, methods, "hash_consensus", minimum_groups))
    groups = materialize(dedup.duplicate_groups(
        rows, F.col("hash_consensus"), "hash_consensus", seed, content="rgb_sha256"
    ))
    annotated = materialize(dedup.annotate(rows, F.col("hash_consensus"), groups))
    tables = {
        "hashes": rows,
        "global_summary": vt.global_summary(values),
        "per_class": classes,
        "consensus_groups": groups.withColumn("classes_json", F.to_json("classes")).drop("classes"),
        "retained_representatives": dedup.retained(annotated),
        "removed_excess_copies": dedup.removed(annotated),
    }
    overlap = materialize(vt.cross_split_overlap(values))
    if overlap.take(1):
        tables["original_cross_split_overlap"] = overlap
    for name, table in tables.items():
        write_table(table, f"{output}/{name}", fmt=fmt)
    metadata = audit_metadata(rows, groups, classes, minimum_groups, seed)
    if checks is not None:
        write_table(checks, f"{output}/exact_group_checks", fmt=fmt)
        # One row per digest.
        counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("identity", "verified_repeats"))))
        compared = checks.groupBy().agg(counts.alias("verified_repeats"), F.sum("repeated_groups").alias("verified_groups"))
        one = F.lit(1).alias("_one")
        metadata = metadata.select("*", one).join(compared.select("*", one), "_one").drop("_one")
    metadata = materialize(metadata)
    write_table(metadata, f"{output}/run_metadata", fmt="json")
    lines = materialize(output_checksums(spark, output))
    lines.orderBy("name").select("line").write.text(f"{output}/checksums")
    return metadata


def audit_folder(spark: SparkSession, root: str, output: str, layout: str, train: str = "train",
                 evaluation: str = "test", **options) -> DataFrame:
    """Audit a class-folder image dataset."""
    if layout == "class_folders":
        inventory = folders.class_folders(spark, root)
    elif layout == "split_class_folders":
        inventory = folders.split_folders(spark, root, train, evaluation)
    else:
        raise ValueError("layout is 'class_folders' or 'split_class_folders'")
    return run_audit(spark, folders.hash_samples(spark, root, inventory), output, train, evaluation, **options)

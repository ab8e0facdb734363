"""Whole protocols: freeze, verify before reuse, and detect tampering."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from copycensus.plans.protocol import deduplicate_then_split, frozen_split, run_tree_audit
from copycensus.sources import samples
from test_folders import runs  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return samples.documents(spark, SF).select(
        "sample_id", "original_split", "class_label", "file_sha256", "rgb_sha256", "input_sha256"
    )


def test_frozen_split_is_reused_or_refused(spark, rows, tmp_path):
    folder = str(tmp_path / "p")
    first = frozen_split(rows, folder)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, frozen_split(rows, folder).collect()))
    with pytest.raises(ValueError, match="Settings are not those frozen"):
        frozen_split(rows, folder, seed=1)
    changed = rows.withColumn("file_sha256", F.when(F.col("sample_id") == "3", "x").otherwise(F.col("file_sha256")))
    with pytest.raises(ValueError, match="content_drift=1"):
        frozen_split(changed, folder)
    with pytest.raises(ValueError, match="membership_drift=1"):
        frozen_split(rows.where("sample_id != '3'"), folder)
    tampered = first.withColumn("partition", F.when(F.col("sample_id") == "3", "other").otherwise(F.col("partition")))
    copy = str(tmp_path / "q")
    tampered.write.parquet(f"{copy}/manifest")
    for part in ("seal", "settings"):
        spark.read.format("text" if part == "settings" else "parquet").load(f"{folder}/{part}").write.format(
            "text" if part == "settings" else "parquet").save(f"{copy}/{part}")
    with pytest.raises(ValueError, match="unknown_partition=1.*manifest_digest=1"):
        frozen_split(rows, copy)


def test_deduplicate_then_split(spark, rows, tmp_path):
    out = str(tmp_path / "d")
    meta = deduplicate_then_split(rows, out).first()
    assert meta["retained_representatives"] + meta["removed_excess_copies"] == meta["source_images"] == rows.count()
    assert sum(meta["partition_counts"].values()) == meta["split_images"] and meta["excluded_classes"] == []
    manifest = spark.read.parquet(f"{out}/manifest")
    assert manifest.select("input_sha256").distinct().count() == manifest.count() == meta["split_images"]
    with pytest.raises(FileExistsError):
        deduplicate_then_split(rows, out)
    with pytest.raises(ValueError, match="fewer than 50 retained groups"):
        deduplicate_then_split(rows, str(tmp_path / "e"), minimum=50)


def test_run_tree_audit(spark, runs):  # noqa: F811
    assert run_tree_audit(spark, str(runs), ["full", "clean"], [1, 2]).count() == 0
    target = runs / "full" / "seed_2" / "metrics.json"
    kept = target.read_text()
    spoiled = json.loads(kept) | {"macro_f1": 0.1, "initial_state_sha256": "other"}
    spoiled["artifacts_sha256"] = {"predictions.csv": "0", "absent.bin": "1"}
    target.write_text(json.dumps(spoiled))
    try:
        found = {(r["check"], r["subject"]) for r in run_tree_audit(spark, str(runs), ["full", "clean", "third"], [1, 2]).collect()}
    finally:
        target.write_text(kept)
    assert found == {("metrics", "full/2"), ("initial_state", "2"), ("artifact", "full/2"), ("run_set", "third/1"), ("run_set", "third/2")}

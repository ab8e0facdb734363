"""Image folders, run trees and sinks, on files written by the tests."""

from __future__ import annotations

import hashlib
import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from copycensus.functions import images
from copycensus.operators import scores, verify
from copycensus.plans import reports
from copycensus.plans.audit import audit_folder
from copycensus.plans.protocol import run_tree_audit
from copycensus.sources import folders, tables
from copycensus.sources.folders import relative_path
from fixtures import write_png


def picture(seed: int, size: int = 40) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 256, (size, size, 3), dtype=np.uint8)


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("my corpus") / "set"
    for split in ("train", "val"):
        for c in "ab":
            for i in range(3):
                # The first picture of class a is the same in both splits.
                seed = 100 if (c, i) == ("a", 0) else ord(c) * 10 + i + (500 if split == "val" else 0)
                write_png(root / split / c / f"{i}.png", picture(seed))
    (root / "train" / "a" / "notes.txt").write_text("x")
    return root


def test_split_scan_and_hashes(spark, corpus):
    inventory = folders.split_folders(spark, str(corpus), "train", "val")
    assert inventory.count() == 12
    hashed = folders.hash_samples(spark, str(corpus), inventory).cache()
    for r in hashed.collect():
        raw = (corpus / r["sample_id"]).read_bytes()
        assert r["file_sha256"] == hashlib.sha256(raw).hexdigest() and r["file_size_bytes"] == len(raw)
        assert (r["source_mode"], r["width"], r["height"]) == ("RGB", 40, 40)
        assert all(len(r[s]) == 16 for s in ("ahash", "dhash", "phash"))
        split, c, name = r["sample_id"].split("/")
        assert (r["original_split"], r["class_label"]) == (split, c)
    first = picture(100)
    header = json.dumps({"shape": [40, 40, 3], "dtype": "|u1"}, sort_keys=True, separators=(",", ":")).encode()
    expected = hashlib.sha256(header + b"\n" + first.tobytes()).hexdigest()
    found = {r["sample_id"]: r["rgb_sha256"] for r in hashed.select("sample_id", "rgb_sha256").collect()}
    assert found["train/a/0.png"] == found["val/a/0.png"] == expected


def test_other_scans(spark, corpus, tmp_path):
    assert folders.strict_layout(spark, str(corpus)).count() == 12
    assert folders.class_folders(spark, str(corpus / "train")).where("original_split = 'pooled'").count() == 6
    loose = folders.loose_folders(spark, str(corpus))
    assert loose.count() == 12 and {r[0] for r in loose.select("class_label").distinct().collect()} == {"a", "b"}
    assert folders.loose_folders(spark, str(tmp_path / "absent")).count() == 0
    with pytest.raises(ValueError, match="Split folder"):
        folders.split_folders(spark, str(corpus), "train", "test")
    write_png(tmp_path / "odd" / "x.png", picture(1))
    with pytest.raises(ValueError, match="Paths other than"):
        folders.strict_layout(spark, str(tmp_path / "odd"))
    with pytest.raises(ValueError, match="No image files"):
        folders.class_folders(spark, str(tmp_path / "odd"))


def test_decode_guard(spark, corpus):
    inventory = folders.strict_layout(spark, str(corpus))
    shown = folders.decoded(spark, str(corpus))
    assert folders.decode_violations(inventory, shown, (40, 40)).count() == 0
    assert folders.decode_violations(inventory, shown, (300, 300)).count() == 12


def test_resampling_kernels():
    for kind in ("lanczos", "bicubic"):
        m = images.resample_matrix(8, 40, kind)
        assert m.shape == (8, 40) and np.allclose(m.sum(axis=1), 1)
        assert np.allclose(images.resample(np.full((40, 40), 77.0), 8, 9, kind), 77)
    assert np.allclose(images.resample_matrix(40, 40, "lanczos"), np.eye(40), atol=1e-12)
    ramp = np.tile(np.arange(64.0) * 3, (64, 1))
    rgb = np.repeat(ramp[:, :, None], 3, axis=2).astype(np.uint8)
    a, d, p = images.image_signatures(rgb)
    assert (a, d) == ("0f" * 8, "ff" * 8) and len(p) == 16


def test_full_audit(spark, corpus, tmp_path):
    out = str(tmp_path / "audit")
    meta = audit_folder(spark, str(corpus), out, "split_class_folders", "train", "val", minimum_groups=5).first()
    assert meta["images"] == 12 and meta["classes"] == 2 and meta["original_split_counts"] == {"train": 6, "val": 6}
    assert meta["retained_representatives"] == 11 and meta["removed_excess_copies"] == 1
    assert meta["safe_to_construct_label_preserving_clean_split"] and meta["classes_below_minimum"] == []
    overlap = {r["method"]: r for r in spark.read.parquet(f"{out}/original_cross_split_overlap").collect()}
    assert overlap["rgb_sha256"]["evaluation_matched"] == 1
    lines = [r["value"] for r in spark.read.text(f"{out}/checksums").collect()]
    assert lines and all(len(x.split("  ")[0]) == 64 for x in lines)
    with pytest.raises(FileExistsError):
        audit_folder(spark, str(corpus), out, "split_class_folders", "train", "val")
    summary = spark.read.parquet(f"{out}/global_summary")
    report = reports.markdown_lines(reports.global_report(summary).where("method = 'Complete tuple'")).first()["line"]
    assert report == "| Complete tuple | 11 | 1 | 8.33% | 0 |"


@pytest.fixture(scope="module")
def runs(tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    truth, guess = ["a", "a", "b", "b"], ["a", "b", "b", "b"]
    for condition in ("full", "clean"):
        for seed in (1, 2):
            run = root / condition / f"seed_{seed}"
            run.mkdir(parents=True)
            lines = ["sample_id,true_label,predicted_label,prob_a,prob_b"]
            lines += [f"{i},{t},{g},{0.9 if g == 'a' else 0.1},{0.1 if g == 'a' else 0.9}" for i, (t, g) in enumerate(zip(truth, guess))]
            (run / "predictions.csv").write_text("\n".join(lines) + "\n")
            (run / "per_class.csv").write_text("class_label,support,precision,recall,f1\na,2,1.0,0.5,0.6666666666666666\nb,2,0.6666666666666666,1.0,0.8\n")
            (run / "confusion_matrix.csv").write_text("true_class,a,b\na,1,1\nb,0,2\n")
            digest = hashlib.sha256((run / "predictions.csv").read_bytes()).hexdigest()
            (run / "metrics.json").write_text(json.dumps({
                "condition": condition, "seed": seed, "accuracy": 0.75, "macro_f1": (2 / 3 + 0.8) / 2, "macro_recall": 0.75,
                "evaluation_images": 4, "initial_state_sha256": f"s{seed}", "artifacts_sha256": {"predictions.csv": digest}}))
    return root


def test_run_tree(spark, runs):
    found = tables.read_runs(spark, str(runs)).cache()
    assert found.count() == 4
    assert verify.run_completeness(found, ["full", "clean"], [1, 2]).count() == 0
    assert {r["initial_states"] for r in verify.paired_start_check(found, ["seed"]).collect()} == {1}
    keys = ["condition", "seed"]
    files = tables.run_artifacts(spark, str(runs))
    assert verify.artifact_drift(found, files, keys).count() == 0
    predictions, classes = tables.probabilities(tables.read_run_tables(spark, str(runs), "predictions.csv"))
    assert classes == ["a", "b"]
    assert scores.prediction_violations(predictions, keys, classes).agg(
        F.sum(F.col("unknown_label") + F.col("not_arg_max") + F.col("nonfinite"))).first()[0] == 0
    stored_classes = tables.read_run_tables(spark, str(runs), "per_class.csv")
    confusion = tables.confusion_long(tables.read_run_tables(spark, str(runs), "confusion_matrix.csv"), classes)
    args = (predictions, found, stored_classes, confusion, keys, classes)
    assert scores.score_violations(*args).count() == 0
    spoiled = found.withColumn("accuracy", F.when(F.col("seed") == 1, 0.8).otherwise(F.col("accuracy")))
    wrong = scores.score_violations(predictions, spoiled, *args[2:]).collect()
    assert {(r["check"], r["field"]) for r in wrong} == {("metrics", "accuracy")} and len(wrong) == 2


def test_run_tree_of_studies(spark, runs, tmp_path):
    """A level above the conditions: keys from the path, gaps and changed files found in the one study that has them."""
    for study in ("first", "second"):
        shutil.copytree(runs, tmp_path / study)
    levels = ("study", "condition", "seed")
    keys = {(r["study"], r["condition"], r["seed"]) for r in tables.read_runs(spark, str(tmp_path), levels).collect()}
    assert keys == {(s, c, n) for s in ("first", "second") for c in ("full", "clean") for n in (1, 2)}
    audit = lambda: {tuple(r) for r in run_tree_audit(spark, str(tmp_path), ["full", "clean"], [1, 2], levels=levels).collect()}
    assert audit() == set()
    (tmp_path / "second" / "clean" / "seed_2" / "per_class.csv").write_text(
        "class_label,support,precision,recall,f1\na,2,1.0,0.5,0.6666666666666666\nb,2,0.6666666666666666,0.9,0.8\n")
    shutil.rmtree(tmp_path / "first" / "full" / "seed_1")
    assert {r[:2] for r in audit()} == {("run_set", "first/full/1"), ("per_class", "second/clean/2/b")}
    (tmp_path / "first" / "full" / "seed_2" / "metrics.json").write_text(json.dumps({"study": "other", "condition": "full", "seed": 2}))
    with pytest.raises(ValueError, match="disagree with the folder"):
        tables.read_runs(spark, str(tmp_path), levels)


def test_run_identity_must_match_path(spark, tmp_path):
    run = tmp_path / "full" / "seed_3"
    run.mkdir(parents=True)
    (run / "metrics.json").write_text(json.dumps({"condition": "full", "seed": 4}))
    with pytest.raises(ValueError, match="disagree with the folder"):
        tables.read_runs(spark, str(tmp_path))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'say "hi", x'), ("b", "")], ["sample_id", "note"])
    out = str(tmp_path / "t")
    tables.write_table(rows, out, ["note", "sample_id"], fmt="csv")
    back = tables.read_manifest(spark, out, ["note", "sample_id"])
    assert sorted(map(tuple, back.collect())) == [("", "b"), ('say "hi", x', "a")]
    with pytest.raises(Exception, match="exists"):
        tables.write_table(rows, out, fmt="csv")
    frozen = str(tmp_path / "f")
    tables.freeze_table(rows, frozen)
    tables.freeze_table(rows.orderBy(F.desc("sample_id")), frozen)
    with pytest.raises(ValueError, match="not those frozen"):
        tables.freeze_table(rows.limit(1), frozen)
    settings = str(tmp_path / "s")
    tables.freeze_settings(spark, settings, {"lr": 0.01})
    tables.freeze_settings(spark, settings, {"lr": 0.01})
    with pytest.raises(ValueError, match="not those frozen"):
        tables.freeze_settings(spark, settings, {"lr": 0.1})


def test_run_tables_with_other_headers_are_reported(spark, tmp_path):
    for seed, header in ((1, "id,prob_a,prob_b"), (2, "id,prob_b,prob_a")):
        folder = tmp_path / "full" / f"seed_{seed}"
        folder.mkdir(parents=True)
        (folder / "p.csv").write_text(f"{header}\nx,0.9,0.1\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        tables.read_run_tables(spark, str(tmp_path), "p.csv").collect()


def test_folders_without_a_seed_number_are_reported(spark, tmp_path):
    for name, seed in (("seed_3", 3), ("seed_x", 4)):
        folder = tmp_path / "full" / name
        folder.mkdir(parents=True)
        (folder / "metrics.json").write_text('{"condition": "full", "seed": %d}' % seed)
    with pytest.raises(ValueError, match="disagree"):
        tables.read_runs(spark, str(tmp_path))


def test_long_paths_are_whole(spark):
    long = "/".join(["d" * 200] * 10)
    row = spark.range(1).select(relative_path(F.lit(f"file:/root/x/{long}"), "/root/x").alias("p")).first()
    assert row["p"] == long

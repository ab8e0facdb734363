"""Missing and conflicting labels, exact shares, and classes short of training-only groups: results as the SQL defines them."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from copycensus.functions import signals
from copycensus.operators import conditions as cond
from copycensus.operators import dedup, exposure, splits, votes
from copycensus.plans.queries import REGISTRY


def test_shares_round_as_decimals(spark):
    """45 * 0.7 is 31.5, which a double has just below; halves go to the even number."""
    found = spark.range(1, 2000).select("id", *splits.shares(F.col("id"), 0.7, 0.2)).collect()
    for n, fit, development in found:
        half_even = [int((n * Decimal(s)).quantize(Decimal(1), ROUND_HALF_EVEN)) for s in ("0.7", "0.2")]
        assert [fit, development] == half_even, n


def _documents(spark, folder, rows):
    data = [(i, text, lang, "web", len(text)) for i, (text, lang) in enumerate(rows)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_conflicting_and_missing_labels_are_no_error(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows = [(w, lang) for w in words for lang in ("en", "fr", None)]
    folder = _documents(spark, tmp_path, rows)
    kept = REGISTRY["dedup_exact_fatal"](spark, folder).collect()
    assert len(kept) == len(words) and {(r["duplicate_group_size"], r["group_class_count"]) for r in kept} == {(3, 2)}
    split = {int(r["sample_id"]): r["partition"] for r in REGISTRY["group_development_split"](spark, folder).collect()}
    assert sorted(split) == list(range(len(rows)))
    for g in range(len(words)):
        assert len({split[i] for i in range(3 * g, 3 * g + 3)} - {"evaluation"}) <= 1
    checks = {r["check"]: r["violations"] for r in REGISTRY["split_violations"](spark, folder).collect()}
    assert checks["development_overlap_input_sha256"] == 0 and checks["repeated_sample_ids"] == 0


def test_a_class_short_of_groups_gives_all_it_has(spark):
    """One of ten training rows lies in a group that is wholly in training, and the target is two."""
    rows = [("a", "train", "x", "own")] + [(f"{s[0]}{i}", s, "x", f"k{i}") for i in range(9) for s in ("train", "val")]
    table = spark.createDataFrame(rows, "sample_id string, original_split string, class_label string, input_sha256 string")
    with pytest.raises(ValueError, match="Insufficient"):
        splits.group_development_split(table)
    found = splits.group_development_split(table, strict=False).where("partition = 'development'").collect()
    assert [r["sample_id"] for r in found] == ["a"]


def test_a_missing_label_does_not_make_a_group_mixed(spark):
    """A copy without a label leaves its group pure; a representative without one stands for no class."""
    data = [(f"s{i}", None if i % 4 == 1 else "x", f"k{i // 2}") for i in range(80)]
    rows = spark.createDataFrame(data, "sample_id string, class_label string, hash_consensus string")
    groups = dedup.duplicate_groups(rows, F.col("hash_consensus"), "r", 9, null_label=False)
    assert {r["group_class_count"] for r in groups.collect()} == {1}
    label = {s: c for s, c, _ in data}
    clean = {r["representative_sample_id"] for r in groups.collect() if label[r["representative_sample_id"]]}
    table = cond.group_conditions(rows, groups, 10)
    assert {r["sample_id"] for r in table.where("clean_consensus is not null").collect()} == clean
    summary = {r["condition"]: r for r in exposure.condition_summary(table, list(cond.GROUP_CONDITIONS)).collect()}
    assert summary["full_all"]["classes"] == 1 and summary["random_subsample"]["images"] == len(clean)


def test_signatures_hold_one_slice_at_a_time(spark):
    """However many rows a batch has, grids are made of few; slices change no signature, nulls stay null."""
    texts = pa.array([None if i % 97 == 5 else f"row {i} " * (i % 40) for i in range(1000)])
    sizes = []

    def cells(part: pa.Array):
        sizes.append(len(part))
        return signals._text_cells(part)

    made = signals._in_slices(texts, cells)
    assert max(sizes) <= signals.SLICE_ROWS and sum(sizes) == 1000
    assert made.equals(signals._in_slices(texts, cells, rows=1000))
    assert [made[i]["ahash"].as_py() is None for i in range(1000)] == [t is None for t in texts.to_pylist()]


def test_votes_of_huge_and_ordinary_values_agree(spark):
    """The way by windows and that by salted aggregates; nulls agree with nothing, and rows are not copied per combination."""
    rows = spark.range(1200).select(
        F.col("id").cast("string").alias("sample_id"), F.when(F.col("id") % 3 == 0, "train").otherwise("val").alias("original_split"),
        F.concat(F.lit("c"), (F.col("id") % 7).cast("string")).alias("class_label"),
        F.when(F.col("id") % 5 > 0, "same").otherwise(F.concat(F.lit("a"), F.col("id") % 40)).alias("ahash"),
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("d"), F.col("id") % 60)).alias("dhash"),
        F.concat(F.lit("p"), F.col("id") % 90).alias("phash"),
    ).cache()
    data = rows.collect()
    agree = lambda e, t: [e[k] is not None and e[k] == t[k] for k in ("ahash", "dhash", "phash")]
    pairs = [(e, t, sum(agree(e, t))) for e in data if e["original_split"] == "val" for t in data if t["original_split"] == "train"]
    for hot_rows in (1, 1_000_000):
        found = {r["votes"]: r for r in votes.vote_stats(rows, hot_rows=hot_rows).collect()}
        for name, least in (("at_least_one", 1), ("at_least_two", 2)):
            hits = [(e, t) for e, t, v in pairs if v >= least]
            others = {e["sample_id"] for e, t in hits if e["class_label"] != t["class_label"]}
            assert [int(x) for x in list(found[name])[1:]] == [len({e["sample_id"] for e, _ in hits}), len(hits), len(others)]
    plan = votes.vote_stats(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3


def test_overview_with_missing_values_writes_a_row_per_class(spark, monkeypatch):
    """Missing contents, groups and labels count as in the SQL; besides the folded rows nothing of their size is written."""
    rows = [("a", "t1", "x"), ("a", "t1", "y"), ("b", "t2", "x"), ("c", "t2", "x"), (None, "t3", "x"), ("d", "t4", None), ("d", "t4", "x"), ("e", None, "y"), ("f", "t5", None)]
    rows += [(f"g{i}", f"u{i}", "x") for i in range(50)]
    written = []
    plain = dedup.materialize
    monkeypatch.setattr(dedup, "materialize", lambda df: written.append(plain(df)) or written[-1])
    table = spark.createDataFrame([("s", *r) for r in rows], "dataset string, exact string, tuple string, class_label string")
    found = dedup.dataset_overview(table, "exact", "tuple", 2).collect()
    assert len(found) == 1
    groups = {t: [r for r in rows if r[1] == t] for t in {r[1] for r in rows}}
    mixed = {t for t, g in groups.items() if len({r[2] for r in g} - {None}) > 1}
    kept = [r for r in rows if None not in r[1:] and r[2] == "x"]  # class y has one group only
    expected = {
        "images": len(rows), "exact_groups": len({r[0] for r in rows} - {None}), "consensus_groups": len(groups), "mixed_label_consensus_groups": 1,
        "images_in_mixed_label_consensus_groups": 2, "exact_mixed_label_consensus_groups": 1, "classes": 2, "eligible_classes": 2, "excluded_classes": "y",
        "eligible_original_images": len(kept), "mixed_label_images_removed": 1, "retained_pure_groups": len({r[1] for r in kept} - mixed),
    }
    assert {k: found[0][k] for k in expected} == expected
    assert [df.count() for df in written[1:]] == [3]

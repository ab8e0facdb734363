"""Known results on small tables, input-order independence, and error cases."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from copycensus.functions import signals
from copycensus.functions.identity import hash_mask, stable_rank, unsafe_path
from copycensus.functions.stats import t_critical
from copycensus.operators import agreement, contrasts, dedup, exposure, scores, splits, verify
from copycensus.operators import conditions as cond
from copycensus.operators import value_table as vt
from fixtures import orchard, partitioned_orchard


def table(spark, rows, shuffle_seed=None):
    rows = list(rows)
    if shuffle_seed is not None:
        random.Random(shuffle_seed).shuffle(rows)
    return spark.createDataFrame(rows)


def ids(df):
    return sorted(tuple(r) for r in df.collect())


def test_group_split_is_whole_by_group_and_large_enough(spark):
    source = orchard()
    split = splits.group_development_split(table(spark, source), fraction=0.25, seed=8)
    part = {r["sample_id"]: r["partition"] for r in split.collect()}
    assert set(part) == {r["sample_id"] for r in source}
    by_key = {}
    for r in source:
        if r["original_split"] == "train":
            by_key.setdefault(r["input_sha256"], set()).add(part[r["sample_id"]])
        else:
            assert part[r["sample_id"]] == "evaluation"
    assert all(len(p) == 1 for p in by_key.values())
    for label in {r["class_label"] for r in source}:
        train = [r for r in source if r["class_label"] == label and r["original_split"] == "train"]
        reserved = sum(part[r["sample_id"]] == "development" for r in train)
        # The last group taken may go beyond the share by its size less one, and no group has more than three rows.
        assert round(0.25 * len(train)) <= reserved < round(0.25 * len(train)) + 3
        assert by_key[f"{label}-8"] == {"fitting"}  # it recurs in the other split
    found = splits.split_violations(split, ["rgb_sha256", "input_sha256"], "val").collect()
    assert all(r["violations"] == 0 for r in found)


@pytest.mark.parametrize("shuffle_seed", [1, 2])
def test_group_split_is_a_function_of_the_set(spark, shuffle_seed):
    columns = ["sample_id", "partition"]
    a = splits.group_development_split(table(spark, orchard())).select(columns)
    b = splits.group_development_split(table(spark, orchard(), shuffle_seed).repartition(5)).select(columns)
    assert ids(a) == ids(b)


def test_group_split_refuses_what_it_cannot_split(spark):
    with pytest.raises(ValueError, match="Insufficient"):
        splits.group_development_split(table(spark, [{**r, "input_sha256": "all of " + r["class_label"]} for r in orchard()]))
    with pytest.raises(ValueError, match="more than one label"):
        splits.group_development_split(table(spark, [
            {**r, "input_sha256": "both"} if r["sample_id"] in ("apple/12", "plum/12") else r for r in orchard()]))


def test_summary_and_overlap_against_counting(spark):
    source = orchard()
    rows = table(spark, source)
    groups = {}
    for r in source:
        groups.setdefault(r["input_sha256"], []).append(r)
    repeated = [g for g in groups.values() if len(g) > 1]
    values = vt.value_table(rows, ["input_sha256"], vt.split_counts())
    s = vt.global_summary(values).first()
    assert (s["images"], s["distinct_groups"], s["excess_copies"]) == (len(source), len(groups), len(source) - len(groups))
    assert s["redundancy_fraction"] == pytest.approx(1 - len(groups) / len(source))
    assert (s["nonsingleton_groups"], s["images_in_nonsingleton_groups"], s["mixed_label_groups"]) == (
        len(repeated), sum(map(len, repeated)), 0)
    o = vt.cross_split_overlap(values).first()
    assert (o["evaluation_images"], o["evaluation_matched"], o["same_label_matched"], o["other_label_matched"]) == (9, 3, 3, 0)
    assert o["evaluation_overlap_fraction"] == pytest.approx(1 / 3)
    one_split = vt.value_table(rows.withColumn("original_split", F.lit("all")), ["input_sha256"], vt.split_counts())
    assert vt.cross_split_overlap(one_split).count() == 0


def predictions(spark):
    return spark.createDataFrame(
        [("r", "a", "a"), ("r", "a", "b"), ("r", "b", "b"), ("r", "b", "b")], ["run", "true_label", "predicted_label"]
    )


def test_scores(spark):
    found = {r["class_label"]: r for r in scores.class_scores(predictions(spark), ["run"], ["a", "b"]).collect()}
    assert (found["a"]["recall"], found["a"]["precision"], found["b"]["recall"]) == (0.5, 1.0, 1.0)
    assert found["b"]["precision"] == pytest.approx(2 / 3)
    overall = scores.overall_scores(scores.class_scores(predictions(spark), ["run"], ["a", "b"]), ["run"]).first()
    assert overall["accuracy"] == 0.75 and overall["macro_f1"] == pytest.approx((2 / 3 + 0.8) / 2)
    wide = {r["true_class"]: (r["a"], r["b"]) for r in scores.confusion_wide(predictions(spark), ["run"], ["a", "b"]).collect()}
    assert wide == {"a": (1, 1), "b": (0, 2)}
    third = scores.overall_scores(scores.class_scores(predictions(spark), ["run"], ["a", "b", "c"]), ["run"]).first()
    assert third["macro_recall"] == pytest.approx(1.5 / 3)


EVAL = ("evaluation",)


def conditions(spark, rows=None, shuffle_seed=None, seed=123):
    return cond.paired_conditions(table(spark, rows or partitioned_orchard(), shuffle_seed), "rgb_sha256", EVAL, seed)


def test_conditions_drop_recurring_rows_and_as_many_others(spark):
    source = partitioned_orchard()
    marked = conditions(spark).cache()
    held = {r["rgb_sha256"] for r in source if r["partition"] == "evaluation"}
    exposed = {r["sample_id"] for r in source if r["partition"] == "fitting" and r["rgb_sha256"] in held}
    assert {r["sample_id"] for r in marked.where("exposed").collect()} == exposed and len(exposed) == 6
    for label, size in (("apple", 11), ("plum", 9)):
        fit = marked.where(f"partition = 'fitting' and class_label = '{label}'")
        assert fit.count() == size and fit.where("in_clean").count() == fit.where("in_control").count() == size - 3
    assert marked.where("partition <> 'fitting' and not (in_clean and in_control)").count() == 0
    assert all(r["violations"] == 0 for r in cond.condition_violations(marked, "rgb_sha256", EVAL).collect())
    for r in exposure.condition_exposure_global(marked, {"rgb_sha256": "native", "input_sha256": "input"}).collect():
        assert r["clean_exact_evaluation_native_matches"] == 0
        assert r["full_evaluation_native_matches"] == 2
        assert r["clean_exact_fitting"] == r["random_control_fitting"] == (8 if r["class_label"] == "apple" else 6)
    assert cond.condition_rows(marked, ["sample_id"]).count() == 3 * len(source) - 2 * len(exposed)


@pytest.mark.parametrize("shuffle_seed", [4, 6])
def test_conditions_are_a_function_of_the_set(spark, shuffle_seed):
    columns = ["sample_id", "in_clean", "in_control"]
    assert ids(conditions(spark).select(columns)) == ids(conditions(spark, shuffle_seed=shuffle_seed).select(columns))


def test_conditions_look_at_keys_and_not_at_labels(spark):
    rows = [{**r, "rgb_sha256": "apple-e1"} if r["sample_id"] == "fit-plum-7" else r for r in partitioned_orchard()]
    assert conditions(spark, rows).where("exposed and sample_id = 'fit-plum-7'").count() == 1


def test_conditions_refuse_empty_classes_and_nothing_to_do(spark):
    whole = [{**r, "rgb_sha256": "plum-e0"} if r["sample_id"].startswith("fit-plum") else r for r in partitioned_orchard()]
    with pytest.raises(ValueError, match="exhausts"):
        conditions(spark, whole)
    with pytest.raises(ValueError, match="nothing to clean"):
        conditions(spark, [{**r, "rgb_sha256": "only " + r["sample_id"]} for r in partitioned_orchard()])


def test_null_keys_and_labels_lose_no_row(spark):
    rows = [{**r, "input_sha256": None if i % 7 == 0 else r["input_sha256"], "class_label": None if i % 5 == 0 else r["class_label"]}
            for i, r in enumerate(orchard())]
    frame = spark.createDataFrame(rows, "sample_id string, original_split string, class_label string, rgb_sha256 string, input_sha256 string")
    groups = dedup.duplicate_groups(frame, F.col("input_sha256"), "r", 5, content="rgb_sha256").cache()
    assert groups.agg(F.sum("duplicate_group_size")).first()[0] == len(rows)
    marked = dedup.annotate(frame, F.col("input_sha256"), groups).cache()
    assert dedup.retained(marked).count() == groups.count() and dedup.retained(marked).count() + dedup.removed(marked).count() == len(rows)
    split = splits.stratified_split(frame.select("sample_id", "class_label")).cache()
    assert split.count() == len(rows)
    n = sum(r["class_label"] is None for r in rows)
    nulls = {r["partition"]: r["count"] for r in split.where("class_label is null").groupBy("partition").count().collect()}
    assert (nulls["fitting"], nulls["development"]) == (round(n * 0.7), round(n * 0.2))
    parts = [{**r, "rgb_sha256": None if r["rgb_sha256"].endswith(("f5", "e3")) else r["rgb_sha256"]} for r in partitioned_orchard()]
    assert cond.paired_conditions(spark.createDataFrame(
        parts, "sample_id string, class_label string, partition string, rgb_sha256 string, input_sha256 string"), "rgb_sha256", EVAL).count() == len(parts)


def test_null_text_has_null_signatures(spark):
    rows = spark.createDataFrame([(None, None), ("some text", [0.5 * i for i in range(64)])], "text string, signal array<double>")
    for made in (signals.text_signatures("text"), signals.vector_signatures("signal")):
        a, b = (r["s"] for r in rows.select(made.alias("s"), "text").orderBy(F.col("text").isNotNull()).collect())
        assert (a is None or list(a) == [None] * 3) and all(len(x) == 16 for x in b)


def test_colliding_digest_is_found_by_comparing_bytes(spark):
    rows = spark.createDataFrame([("d", "x"), ("d", "x"), ("d", "y"), ("e", "z"), (None, "u"), (None, "v")], "digest string, payload string")
    r = dedup.verify_exact_groups(rows, "digest", "payload").first()
    assert (r["repeated_groups"], r["verified_repeats"], r["groups_that_differ"]) == (2, 3, 2)
    assert dedup.verify_exact_groups(rows.where("false"), "digest", "payload").first()["verified_repeats"] == 0


def test_strict_and_clamped_splits(spark):
    rows = spark.range(40).select(
        F.col("id").cast("string").alias("sample_id"),
        F.when(F.col("id") < 4, "small").otherwise("large").alias("class_label"),
    )
    with pytest.raises(ValueError, match="all three partitions"):
        splits.stratified_split(rows, 0.7, 0.1)
    sizes = {(r[0], r[1]): r[2] for r in splits.stratified_split(rows, 0.7, 0.2, clamped=True)
             .groupBy("class_label", "partition").count().collect()}
    assert sizes[("small", "fitting")] == 2 and sizes[("small", "evaluation")] == 1
    assert sizes[("large", "fitting")] == 25 and sizes[("large", "development")] == 7
    with pytest.raises(ValueError, match="shares"):
        splits.stratified_split(rows, 0.9, 0.2)


def test_rounding_is_half_to_even(spark):
    sizes = spark.range(3, 400).select(F.col("id").cast("string").alias("class_label"), F.col("id").alias("class_size"))
    for r in splits.allocate(sizes.where("id >= 10"), 0.7, 0.2).collect():
        assert (r["n_fit"], r["n_dev"]) == (round(r["class_size"] * 0.7), round(r["class_size"] * 0.2))


def test_two_way_split_falls_back(spark):
    rows = spark.createDataFrame([(str(i), "x" if i else "only") for i in range(10)], ["sample_id", "class_label"])
    counts = dict(splits.two_way_split(rows).groupBy("partition").count().collect())
    assert counts == {"train": 8, "val": 2}


def test_matched_subsample_errors_and_parity(spark):
    source = splits.stratified_split(spark.range(60).select(
        F.col("id").cast("string").alias("sample_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("class_label")))
    clean = source.where("cast(sample_id as int) < 40")
    control = cond.matched_subsample(source, clean).cache()
    cond.require_parity(control, clean)
    assert control.count() == 40 and control.select("sample_id").distinct().count() == 40
    doubled = clean.unionByName(clean)
    with pytest.raises(ValueError, match="Not enough source rows"):
        cond.matched_subsample(source, doubled)
    with pytest.raises(ValueError, match="lack at least one class"):
        cond.restrict_classes(source, clean)


def test_dedup_conflicts_are_fatal_and_named(spark):
    rows = spark.createDataFrame(
        [(str(i), "ab"[i % 2], "k") for i in range(9)] + [("z", "a", "q")], ["sample_id", "class_label", "input_sha256"]
    )
    value = F.col("input_sha256")
    groups = dedup.duplicate_groups(rows, value, "exact_input", 1)
    with pytest.raises(ValueError, match=r"1 duplicate groups carry several labels, for example \[\['0', '1', '2'\]\]"):
        dedup.require_pure(rows, value, groups)
    representative = min(range(9), key=lambda i: (hashlib.sha256(f"1\0{i}".encode()).hexdigest(), str(i)))
    kept = {r["representative_sample_id"] for r in groups.collect()}
    assert kept == {str(representative), "z"}


def test_insufficient_classes(spark):
    counts = spark.createDataFrame([("a", 2), ("b", 9)], ["class_label", "retained_groups"])
    with pytest.raises(ValueError, match="fewer than 3 retained groups: a=2"):
        dedup.insufficient_classes(counts, 3, exclude=False)
    assert [r["class_label"] for r in dedup.insufficient_classes(counts, 3, exclude=True).collect()] == ["a"]


def test_exact_group_verification_finds_differences(spark):
    rows = spark.createDataFrame([("d", "x"), ("d", "y"), ("e", "z"), ("e", "z")], ["digest", "payload"])
    for bytewise in (False, True):
        r = dedup.verify_exact_groups(rows, "digest", "payload", bytewise).first()
        assert (r["repeated_groups"], r["verified_repeats"], r["groups_that_differ"]) == (2, 2, 1)


def test_recipe_selection_reads_development_only(spark):
    rows = spark.createDataFrame(
        [("conservative", 0.3, 0.5, 0.9), ("faster", 0.2, 0.5, 0.1), ("frozen_bn", 0.4, 0.5, 1.0)],
        ["recipe_name", "development_loss", "development_accuracy", "evaluation_accuracy"],
    )
    assert scores.select_recipe(rows).first()["recipe_name"] == "faster"
    with pytest.raises(ValueError, match="without tuning results"):
        scores.select_recipe(rows, ["faster", "absent"])
    broken = rows.withColumn("development_loss", F.lit(float("nan")))
    with pytest.raises(Exception, match="finite"):
        scores.select_recipe(broken).collect()


def test_best_epoch_and_recorded_epochs(spark):
    history = spark.createDataFrame([("r", 0, 0.5), ("r", 1, 0.2), ("r", 2, 0.2)], ["run", "epoch", "development_loss"])
    assert scores.best_epoch(history, ["run"], zero_based=True).first()["selected_epoch"] == 2
    good = spark.createDataFrame([("r", 2, 0.2)], ["run", "selected_epoch", "development_loss"])
    assert scores.epoch_violations(history, good, ["run"], zero_based=True).count() == 0
    assert scores.epoch_violations(history, good, ["run"]).count() == 1


def test_contrast_interval(spark):
    accuracy = {"full": [0.9, 0.92, 0.91, 0.95, 0.9], "clean": [0.88, 0.9, 0.91, 0.9, 0.89]}
    rows = [(c, s, a, a, a) for c, values in accuracy.items() for s, a in enumerate(values)] + [("full", 9, 1.0, 1.0, 1.0)]
    results = spark.createDataFrame(rows, ["condition", "seed", "accuracy", "macro_f1", "macro_recall"])
    deltas = contrasts.seed_contrasts(results, {"full_minus_clean": ("full", "clean")})
    r = contrasts.contrast_summary(deltas).where("metric = 'accuracy'").first()
    assert r["completed_seeds"] == 5 and r["mean_pp"] == pytest.approx(2.0)
    half = t_critical(4) * r["sample_sd_pp"] / 5 ** 0.5
    assert t_critical(4) == pytest.approx(2.7764451051977987, abs=1e-12)
    assert r["ci95_upper_pp"] == pytest.approx(2.0 + half)
    assert r["seed_values_pp"].startswith("0:2.000000;1:2.000000")
    single = contrasts.contrast_summary(deltas.where("seed = 0")).first()
    assert single["sample_sd_pp"] is None and single["ci95_lower_pp"] == single["mean_pp"]
    assert contrasts.contrast_summary(deltas.where("seed = 0"), critical="tabulated").first()["ci95_lower_pp"] is None
    assert verify.sign_claims(deltas, ["metric"]).first()["all_positive"] == 0


def test_class_weights(spark):
    rows = spark.createDataFrame([("a",)] * 90 + [("b",)] * 10, ["class_label"])
    w = {r["class_label"]: r["weight"] for r in scores.class_weights(rows).collect()}
    raw = {"a": (100 / (2 * 90)) ** 0.5, "b": (100 / (2 * 10)) ** 0.5}
    mean = (raw["a"] * 90 + raw["b"] * 10) / 100
    assert w["a"] == pytest.approx(raw["a"] / mean) and w["b"] == pytest.approx(min(2.0, raw["b"] / mean))
    assert {r["weight"] for r in scores.class_weights(rows, "none").collect()} == {1.0}


def test_agreement_and_validation(spark):
    rows = [(1, "p1", " Different"), (1, "p2", "uncertain"), (2, "p1", "different"), (2, "p2", "odd"), (2, "p2", "")]
    given = spark.createDataFrame(rows, ["annotator", "pair_id", "judgement"])
    pairs = spark.createDataFrame([("p1",), ("p3",)], ["pair_id"])
    found = {r["annotator"]: r.asDict() for r in agreement.annotation_violations(given, pairs, 2).collect()}
    assert found[2]["blank_fields"] == 1 and found[2]["unknown_judgements"] == 1 and found[2]["repeated_pair_ids"] == 1
    assert found[1]["ids_not_in_pairs"] == 1 and found[1]["pairs_not_judged"] == 1 and found[2]["row_count_differs"] == 1
    judged = spark.createDataFrame([("a", "x", "x"), ("b", "x", "x")], ["pair_id", "judgement_1", "judgement_2"])
    assert agreement.annotator_agreement(judged).first()["cohen_kappa"] == 1.0


def test_verification_finds_each_fault(spark):
    base = spark.createDataFrame(
        [("a", "x", "f1", "r1"), ("b", "x", "f2", "r2"), ("c", "y", "f3", "r3")],
        ["sample_id", "class_label", "file_sha256", "rgb_sha256"],
    )
    other = spark.createDataFrame(
        [("a", "x", "f1", "r1"), ("b", "z", "f2", "r9"), ("d", "y", "f3", "r3")],
        ["sample_id", "class_label", "file_sha256", "rgb_sha256"],
    )
    r = verify.merge_check(base, other).first()
    assert tuple(r) == (2, 1, 1, 1, 1)
    with pytest.raises(ValueError, match="disagree"):
        verify.checked_merge(base, other, [])
    assert ids(verify.membership_drift(base, other)) == [("c", "added"), ("d", "removed")]
    assert ids(verify.content_drift(base, other)) == [("c", "missing")]
    assert verify.index_violations(base, other).first()["missing_ids"] == 1
    runs = spark.createDataFrame([("full", 1), ("odd", 1)], ["condition", "seed"])
    assert ids(verify.run_completeness(runs, ["full"], [1, 2])) == [("full", 2, "missing"), ("odd", 1, "extra")]
    paths = spark.createDataFrame([("a/b",), ("/a",), ("a/../b",), ("a..b",)], ["p"])
    assert [r[0] for r in paths.where(unsafe_path("p")).collect()] == ["/a", "a/../b"]
    a = spark.createDataFrame([("lr", "1"), ("bs", "8")], ["name", "value"])
    b = spark.createDataFrame([("lr", "2"), ("bs", "8")], ["name", "value"])
    assert ids(verify.settings_differences(a, b)) == [("lr", "1", "2")]
    stored = spark.createDataFrame([("m", 0.5, 1, 2), ("n", 0.6, 1, 2)], ["method", "fraction", "part", "whole"])
    assert [r["method"] for r in verify.fraction_violations(stored, "fraction", "part", "whole").collect()] == ["n"]
    starts = spark.createDataFrame([(1, "s"), (1, "s"), (2, "s"), (2, "t")], ["seed", "initial_state_sha256"])
    assert ids(verify.paired_start_check(starts, ["seed"]).select("seed", "initial_states")) == [(1, 1), (2, 2)]


def test_digests_ignore_order_but_not_content(spark):
    rows = table(spark, orchard()).withColumnRenamed("rgb_sha256", "file_sha256")
    again = table(spark, orchard(), 9).withColumnRenamed("rgb_sha256", "file_sha256")
    changed = rows.withColumn("file_sha256", F.when(F.col("sample_id") == "plum/v1", "q").otherwise(F.col("file_sha256")))
    one, two, three = (verify.snapshot_digest(d).first()["digest"] for d in (rows, again, changed))
    assert one == two != three
    assert verify.rowset_digest(rows).first() == verify.rowset_digest(again).first()


def test_rank_and_mask(spark):
    r = spark.createDataFrame([("s",)], ["sample_id"]).select(
        stable_rank(42, F.col("sample_id")).alias("a"), stable_rank(42, F.col("sample_id"), "select").alias("b")).first()
    assert r["a"] == hashlib.sha256(b"42\0s").hexdigest() and r["b"] == hashlib.sha256(b"42\0select\0s").hexdigest()
    left = spark.createDataFrame([("k", "1", "2", "3")], ["k", "ahash", "dhash", "phash"])
    right = spark.createDataFrame([("k", "1", "x", "3")], ["k", "ahash", "dhash", "phash"])
    assert left.alias("l").join(right.alias("r"), "k").select(hash_mask("l", "r")).first()[0] == 5


def test_batched_runs_fit_and_choose_like_one_run_at_a_time(spark):
    """Against plain averages per run; a class without fitting rows and a run that leaves out rows by a flag."""
    import hashlib

    import numpy as np
    from pyspark.sql import functions as F

    from copycensus.operators import learn

    rng = np.random.default_rng(4)
    parts = ["fitting", "fitting", "development", "evaluation"]
    rows = [(f"s{i}", "abc"[i % 3] if i < 110 else "d", parts[i % 4] if i < 110 else "evaluation", bool(i % 5),
             [float(x) for x in rng.normal(i % 3, 2, 6)]) for i in range(114)]
    table = spark.createDataFrame(rows, "sample_id string, class_label string, partition string, flag boolean, features array<double>").repartition(3)
    made = learn.batched_runs(table, {"all": F.lit(True), "some": F.col("flag")}, [3, 7], list("abcd"), 6, {"wide": (0, 6), "narrow": (2, 4)})
    found = {(r["study"], r["condition"], r["seed"], r["sample_id"]): (r["predicted_label"], r["shrinkage"], r["distance"]) for r in made.predictions(["condition", "seed"]).collect()}
    assert len(found) == 2 * 2 * 2 * sum(r[2] == "evaluation" for r in rows)
    fixed = {r[0]: np.floor(np.array(r[4]) * 1e6) / 1e6 for r in rows}
    for study, (a, b) in {"wide": (0, 6), "narrow": (2, 4)}.items():
        for condition in ("all", "some"):
            for seed in (3, 7):
                used = [r for r in rows if r[2] == "fitting" and (condition == "all" or r[3]) and hashlib.sha256(f"{seed}\0{r[0]}".encode()).hexdigest()[0] < "e"]
                whole = np.mean([fixed[r[0]] for r in used], axis=0)
                best = None
                for s in (0.0, 0.5):
                    centre = {c: (1 - s) * np.mean([fixed[r[0]] for r in used if r[1] == c], axis=0) + s * whole for c in "abc"}
                    far = lambda r: {c: round(float(np.linalg.norm(fixed[r[0]][a:b] - m[a:b])), 6) for c, m in centre.items()}  # noqa: B023, E731
                    losses = [far(r)[r[1]] + np.log(sum(np.exp(-d) for d in far(r).values())) for r in rows if r[2] == "development"]
                    scored = {r[0]: min((d, c) for c, d in far(r).items()) for r in rows if r[2] == "evaluation"}
                    if best is None or round(float(np.mean(losses)), 6) < best[0]:
                        best = (round(float(np.mean(losses)), 6), s, scored)
                for key, (d, c) in best[2].items():
                    label, shrinkage, distance = found[study, condition, seed, key]
                    assert (label, shrinkage) == (c, best[1]) and abs(distance - d) < 2e-6


def test_audit_compares_payloads_of_equal_digests(spark, tmp_path):
    from copycensus.plans.audit import run_audit
    from copycensus.sources import samples

    docs = samples.documents(spark, "/root/testdata/sf0.001").join(
        samples.documents_with_text(spark, "/root/testdata/sf0.001").select("sample_id", "text", "canonical"), "sample_id")
    docs = docs.withColumn("original_split", samples.F.when(samples.F.length("sample_id") > 2, "train").otherwise("test"))
    meta = run_audit(spark, docs, str(tmp_path / "good"), minimum_groups=2, proofs={"file_sha256": "text", "rgb_sha256": "canonical"}).first()
    checks = {r["identity"]: r["verified_repeats"] for r in spark.read.parquet(str(tmp_path / "good" / "exact_group_checks")).collect()}
    assert meta["verified_repeats"] == checks and checks["rgb_sha256"] >= checks["file_sha256"] > 0
    assert "text" not in spark.read.parquet(str(tmp_path / "good" / "hashes")).columns
    with pytest.raises(ValueError, match="different payloads"):
        run_audit(spark, docs.withColumn("text", samples.F.col("sample_id")), str(tmp_path / "bad"), minimum_groups=2, proofs={"file_sha256": "text"})


def test_a_missing_third_party_module_leaves_the_core_queries():
    import subprocess
    import sys as system

    code = ("import sys; sys.modules['sentencepiece'] = None; import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; "
            "from copycensus.plans.queries import REGISTRY; assert set(e.queries()) == set(REGISTRY), 'queries'; assert len(e.oracle_sql()) >= 107")
    subprocess.run([system.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(__file__).resolve().parents[1]))

"""Paths for huge keys: salted joins, ranks without gathering a class, counted pairs."""

from __future__ import annotations

import itertools
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from copycensus.operators import conditions as cond
from copycensus.operators import dedup, pairs, splits, verify, votes
from copycensus.operators.ranking import boundaries, positions, rank_cuts
from copycensus.session import join_groups, materialize, shared_dir
from copycensus.sources import samples

SF = "/root/testdata/sf0.01"


def skewed(spark, n=3000):
    """A third of the rows share one value."""
    return spark.range(n).select(
        F.col("id").cast("string").alias("sample_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") % 700).cast("string"))).alias("value"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("class_label"),
    )


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    rows = skewed(spark)
    groups = materialize(rows.where("value != 'v1'").groupBy("value").agg(F.count(F.lit(1)).alias("size")))
    plain = join_groups(rows, groups, ["value"], "size", how=how)
    salted = join_groups(rows, groups, ["value"], "size", how=how, rows_per_salt=50)
    expected = rows.join(groups, "value", how).select(plain.columns)
    for found in (plain, salted):
        assert sorted(map(tuple, found.select(plain.columns).collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def test_salted_join_deals_a_hot_key_out_evenly(spark):
    """No salt of a hot key has far more rows than asked for, also for a key just under a thousandth of all rows."""
    rows = spark.range(40_000).select(
        F.col("id").cast("string").alias("sample_id"),
        F.when(F.col("id") % 1001 == 0, "warm").when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("value"))
    groups = materialize(rows.groupBy("value").agg(F.count(F.lit(1)).alias("size")))
    salted = join_groups(rows, groups, ["value"], "size", rows_per_salt=20)
    assert salted.count() == 40_000
    salts = F.pmod(F.xxhash64("sample_id"), (F.floor(F.col("size") / 20) + 1))
    assert salted.where("size > 20").groupBy("value", salts).count().agg(F.max("count")).first()[0] < 60


def test_annotate_with_hot_groups(spark):
    rows = skewed(spark)
    groups = materialize(dedup.duplicate_groups(rows, F.col("value"), "r", 7))
    a = dedup.annotate(rows, F.col("value"), groups)
    b = dedup.annotate(rows, F.col("value"), groups, rows_per_salt=100).select(a.columns)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    kept, gone = dedup.retained(b), dedup.removed(b)
    assert kept.count() == groups.count() and kept.count() + gone.count() == rows.count()


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 5)), min_size=4, max_size=30), target=st.integers(1, 40))
def test_boundaries_match_running_sums(spark, data, target):
    import hashlib

    rows = [(c, hashlib.sha256(str(i).encode()).hexdigest() + f" {i}", w) for i, (c, w) in enumerate(data)]
    df = spark.createDataFrame(rows, ["class_label", "order", "w"])
    targets = spark.createDataFrame([("a", "t", target), ("b", "t", 1)], ["class_label", "cut", "target"])
    found = {r["class_label"]: (r["boundary"], r["reached"]) for r in
             boundaries(df, ["class_label"], "order", targets, weight="w", digits=1).collect()}
    for label, goal in (("a", target), ("b", 1)):
        run, expected = 0, None
        for _, order, w in sorted(r for r in rows if r[0] == label):
            run += w
            if run >= goal:
                expected = (order, run)
                break
        assert found.get(label) == expected


def test_positions_number_every_row(spark):
    rows = skewed(spark).select("class_label", (F.length("value")).alias("x"), "sample_id")
    placed = positions(rows, ["class_label"], ["x", "sample_id"]).collect()
    for label in "ab":
        mine = sorted((r["position"], r["x"], r["sample_id"]) for r in placed if r["class_label"] == label)
        assert [p for p, _, _ in mine] == list(range(1, len(mine) + 1))
        assert [(x, s) for _, x, s in mine] == sorted((x, s) for _, x, s in mine)


def test_split_is_a_partition_with_exact_counts(spark):
    rows = samples.events(spark, SF).select("sample_id", "class_label")
    split = splits.stratified_split(rows).cache()
    assert split.count() == rows.count() == split.select("sample_id").distinct().count()
    for r in split.groupBy("class_label").pivot("partition").count().collect():
        n = r["fitting"] + r["development"] + r["evaluation"]
        assert (r["fitting"], r["development"]) == (round(n * 0.7), round(n * 0.2))


def test_split_never_shuffles_the_rows(spark):
    split = splits.stratified_split(samples.events(spark, SF).select("sample_id", "class_label"))
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def brute_votes(rows):
    train = [r for r in rows if r["original_split"] == "train"]
    keys = ("ahash", "dhash", "phash")
    out = {k: [0, 0, 0] for k in (1, 2)}
    for e in (r for r in rows if r["original_split"] == "val"):
        agreed = [(sum(e[k] == t[k] for k in keys), t["class_label"] != e["class_label"]) for t in train]
        for least in (1, 2):
            hits = [o for v, o in agreed if v >= least]
            out[least][0] += bool(hits)
            out[least][1] += len(hits)
            out[least][2] += any(hits)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_votes_match_every_pair(spark, seed):
    rng = random.Random(seed)
    rows = [{"sample_id": str(i), "class_label": rng.choice("xyz"), "original_split": rng.choice(["train", "train", "val"]),
             "ahash": "blank" if rng.random() < 0.4 else str(rng.randrange(4)), "dhash": str(rng.randrange(6)),
             "phash": str(rng.randrange(8)), "rgb_sha256": str(rng.randrange(40))} for i in range(150)]
    df = spark.createDataFrame(rows)
    expected = brute_votes(rows)
    found = {r["votes"]: list(r)[1:] for r in votes.vote_stats(df).collect()}
    assert found == {"at_least_one": expected[1], "at_least_two": expected[2]}
    stats = {r["keys"]: r for r in votes.key_pair_stats(df, {"a": ["ahash"], "ad": ["ahash", "dhash"]}).collect()}
    for name, keys in (("a", ["ahash"]), ("ad", ["ahash", "dhash"])):
        matches = [(e, t) for e, t in itertools.product(rows, rows) if e["original_split"] == "val"
                   and t["original_split"] == "train" and all(e[k] == t[k] for k in keys)]
        assert stats[name]["pairs"] == len(matches)
        assert stats[name]["evaluation_matched"] == len({e["sample_id"] for e, _ in matches})
        assert stats[name]["exact_content_matched"] == len({e["sample_id"] for e, t in matches if e["rgb_sha256"] == t["rgb_sha256"]})


def test_pairs_grow_with_rows_only(spark):
    rows = skewed(spark).withColumns({
        "rgb_sha256": F.col("sample_id"), "ahash": F.col("value"), "dhash": F.col("class_label"), "phash": F.col("value")})
    table = pairs.representative_pairs(rows, "phash", 3, [])
    assert 0 < table.count() <= rows.count()
    assert table.where("sample_id = partner_id").count() == 0


def test_medians(spark):
    rows = spark.createDataFrame([("g", float(x), str(i)) for i, x in enumerate([5, 1, 9, 7])] + [("h", 2.0, "z")], ["g", "x", "u"])
    assert {r["g"]: r["x_median"] for r in pairs.group_medians(rows, "g", "x", "u").collect()} == {"g": 6.0, "h": 2.0}


def test_pair_counts_beyond_64_bits(spark, monkeypatch):
    """5e9 rows of one value on either side."""
    rows = spark.createDataFrame([("1", "x", s, "h", "d", "p", "c") for s in ("train", "val")],
                                 ["sample_id", "class_label", "original_split", "ahash", "dhash", "phash", "rgb_sha256"])
    folded = votes._folded
    monkeypatch.setattr(votes, "_folded", lambda *a: folded(*a).withColumns({n: F.col(n) * 5_000_000_000 for n in ("n_train", "n_eval")}))
    assert {r["votes"]: int(r["pairs"]) for r in votes.vote_stats(rows).collect()} == {
        "at_least_one": 25 * 10**18, "at_least_two": 25 * 10**18}
    assert int(votes.key_pair_stats(rows, {"a": ["ahash"]}).first()["pairs"]) == 25 * 10**18


def test_digest_tree_is_free_of_order_and_partitions(spark):
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("sample_id"), F.lit("c").alias("file_sha256"))
    a = verify.snapshot_digest(rows).first()
    assert a == verify.snapshot_digest(rows.orderBy("sample_id").repartition(7)).first() and a["rows"] == 5000
    assert a["digest"] != verify.snapshot_digest(rows.where("sample_id <> sha2('7', 256)")).first()["digest"]
    assert verify.snapshot_digest(rows.where("false")).first()["rows"] == 0


def test_shared_folder_comes_from_the_session(spark):
    folder = shared_dir(spark)
    assert shared_dir(spark) == folder
    (path,) = {f.rsplit("/", 1)[0] for f in materialize(spark.range(3)).inputFiles()}
    assert f"{folder.removeprefix('file:').replace('//', '/')}/copycensus-" in path.removeprefix("file:").replace("//", "/")


@pytest.mark.parametrize("ordered", [1, 1000])
def test_rank_cuts_equal_a_sort(spark, ordered):
    """Many cuts of two ranks at once, narrowed until a bucket has one row or ordered at once."""
    rows = spark.range(700).select(F.concat(F.lit("s"), "id").alias("sample_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).cast("string").alias("class_label"))
    one, two = splits.rank_order(1), splits.rank_order(2, "other")
    few = F.when(F.col("sample_id").endswith("3"), two)
    found = rank_cuts([(rows, {"a": one}), (rows, {"b": few})], ["class_label"], {
        "first": ("a", F.lit(1)), "half": ("a", F.floor(F.col("n_a") / 2)), "all": ("b", F.col("n_b")),
        "none": ("b", F.lit(0)), "beyond": ("b", F.col("n_b") + 1), "cross": ("a", F.col("n_b")),
    }, digits=1, ordered=ordered)
    got = {r["class_label"]: r.asDict() for r in found.collect()}
    keys = {}
    for r in rows.select("class_label", one.alias("a"), few.alias("b")).collect():
        keys.setdefault(r["class_label"], []).append((r["a"], r["b"]))
    assert set(got) == set(keys) == {None, "0", "1", "2"}
    for label, pairs in keys.items():
        a, b = sorted(x for x, _ in pairs), sorted(x for _, x in pairs if x)
        assert got[label] == {
            "class_label": label, "n_a": len(a), "n_b": len(b), "cut_first": a[0], "cut_half": a[len(a) // 2 - 1], "cut_all": b[-1],
            "cut_none": None, "cut_beyond": None, "cut_cross": a[len(b) - 1],
        }


def test_rank_cuts_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "sample_id string, class_label string")
    assert rank_cuts([(rows, {"a": splits.rank_order(1)})], ["class_label"], {"x": ("a", F.lit(1))}).count() == 0


def test_group_conditions_keep_every_row_once(spark):
    """One row per sample whatever its conditions; a null class is in the whole only; sizes of subsample and clean agree."""
    data = [(f"s{i}", None if i % 11 == 0 else "large" if i % 4 else "small", f"k{i // 3 if i % 5 else i}") for i in range(400)]
    rows = spark.createDataFrame(data, "sample_id string, class_label string, hash_consensus string")
    groups = dedup.duplicate_groups(rows, F.col("hash_consensus"), "hash_consensus", 9)
    table = [r.asDict() for r in cond.group_conditions(rows, groups, 60, ordered=1).collect()]
    assert sorted(r["sample_id"] for r in table) == sorted(s for s, _, _ in data)
    pure = {g["representative_sample_id"]: g["classes"][0] for g in groups.where("group_class_count = 1").collect() if g["classes"]}
    sizes = {c: sum(x == c for x in pure.values()) for c in ("large", "small")}
    assert sizes["small"] < 60 <= sizes["large"]
    for r in table:
        large = r["class_label"] == "large"
        assert r["full_all"] is not None and r["full"] == (r["full_all"] if large else None)
        assert (r["clean_consensus"] is not None) == (large and r["sample_id"] in pure)
        assert large or r["random_subsample"] is None
    count = lambda name: {p: sum(r[name] == p for r in table) for p in splits.PARTITIONS}
    assert count("random_subsample") == count("clean_consensus") and sum(count("clean_consensus").values()) == sizes["large"]
    with pytest.raises(Exception, match="Too few rows"):
        tiny = spark.createDataFrame([("a", "x", "k"), ("b", "x", "l")], rows.schema)
        cond.group_conditions(tiny, dedup.duplicate_groups(tiny, F.col("hash_consensus"), "hash_consensus", 9), 1).collect()

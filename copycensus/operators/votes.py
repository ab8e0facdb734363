"""Candidate statistics across a split for one key, a key tuple, or hash votes.

Train-evaluation pairs are counted, never formed. Rows that agree on all keys
and the label behave alike, so they are folded into one weighted row first: a
signature shared by a third of the corpus costs one row per distinct
combination of the other keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copycensus.functions.identity import SIGNATURES
from copycensus.session import join_groups, materialize


def _folded(rows: DataFrame, keys: list[str], train: str, evaluation: str) -> DataFrame:
    return rows.groupBy(*keys, "class_label").agg(
        F.count_if(F.col("original_split") == train).alias("n_train"),
        F.count_if(F.col("original_split") == evaluation).alias("n_eval"),
    )


def _pairs(evaluation: Column, candidates: Column) -> Column:
    """Product of two row counts; wide, as a value held by many rows on both sides exceeds 64 bits."""
    return evaluation.cast("decimal(19,0)") * candidates.cast("decimal(19,0)")


def joined_key(keys: list[str]) -> Column:
    """Several string keys as one, each behind its length so that no two tuples coincide."""
    return F.concat(*[F.concat(F.length(k).cast("string"), F.lit(":"), F.col(k)) for k in keys])


def _with_candidates(folded: DataFrame, combos: dict[str, Column], carry: list[str]) -> DataFrame:
    """Evaluation rows melted over key combinations, with training counts for each."""
    entries = F.explode(F.array(*[
        F.struct(F.lit(name).alias("combo"), key.alias("value")) for name, key in combos.items()
    ])).alias("k")
    melted = materialize(folded).select("class_label", "n_train", "n_eval", *carry, entries).select(
        "class_label", "n_train", "n_eval", *carry, "k.*"
    )
    # One row per class and value; an evaluation row's own class is always among them.
    labelled = melted.groupBy("combo", "value", "class_label").agg(
        F.sum("n_train").alias("with_label"), F.count_if(F.col("n_eval") > 0).alias("probes")
    )
    known = materialize(
        labelled.withColumn("candidates", F.sum("with_label").over(W.partitionBy("combo", "value")))
        .where("candidates > 0 and probes > 0")
    )
    probes = melted.where("n_eval > 0").withColumn("_id", F.concat_ws("|", "combo", *carry))
    keys = ["combo", "value", "class_label"]
    return join_groups(probes, known, keys, "probes", id_col="_id").drop("probes", "_id")


def key_pair_stats(
    rows: DataFrame, keysets: dict[str, list[str]], content: str = "rgb_sha256",
    train: str = "train", evaluation: str = "val",
) -> DataFrame:
    """For each key tuple: matched evaluation rows, pairs, and label or content agreement."""
    keys = sorted({k for ks in keysets.values() for k in ks})
    folded = _folded(rows, [*keys, content], train, evaluation)
    combos = {}
    for name, ks in keysets.items():
        combos[name] = joined_key(ks)
        combos[f"{name}+content"] = joined_key([*ks, content])
    hits = _with_candidates(folded, combos, [*keys, content])
    plain = ~F.col("combo").endswith("+content")
    ev = F.col("n_eval")
    return (
        hits.withColumn("keys", F.regexp_replace("combo", r"\+content$", ""))
        .groupBy("keys")
        .agg(
            F.sum(F.when(plain, ev).otherwise(0)).alias("evaluation_matched"),
            F.sum(F.when(plain, _pairs(ev, F.col("candidates"))).otherwise(0)).alias("pairs"),
            F.sum(F.when(plain & (F.col("candidates") > F.col("with_label")), ev).otherwise(0)).alias(
                "other_label_matched"
            ),
            F.sum(F.when(~plain, ev).otherwise(0)).alias("exact_content_matched"),
        )
    )


#: Hash buckets by which huge values of a key are looked for, and folded rows that one of them may have (or eight times the mean).
BUCKETS, HOT_ROWS = 1 << 14, 1_000_000


def _add_candidates(folded: DataFrame, combos: list[list[str]], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``folded`` with, per combination of keys, its training rows ``c<i>`` and whether one has another label, ``o<i>``.

    All combinations begin with the same key, so one shuffle by it brings the rows together for all of their windows. Rows
    in the hash bucket of a huge value would lie in one task: they get aggregates, joined with salts, instead. A null key
    agrees with nothing.
    """
    first = combos[0][0]
    trains = F.when(F.col("n_train") > 0, F.col("class_label"))
    measures = [F.sum("n_train"), F.min(trains), F.max(trains)]
    bucket = F.pmod(F.xxhash64(first), F.lit(BUCKETS)).cast("int")
    sizes = folded.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    limit = F.greatest(F.lit(hot_rows), 8 * F.sum("n").over(W.partitionBy()) / BUCKETS)
    # At most an eighth of the buckets.
    hot = [r["bucket"] for r in sizes.withColumn("limit", limit).where("n > limit").select("bucket").collect()]

    def finished(rows: DataFrame, i: int) -> DataFrame:
        known = F.greatest(*[F.col(k).isNull().cast("int") for k in combos[i]], F.lit(0)) == 0
        other = (F.col("_lo") != F.col("class_label")) | (F.col("_hi") != F.col("class_label"))
        return rows.withColumns({
            f"c{i}": F.when(known, F.col("_n")).otherwise(0), f"o{i}": F.coalesce(known & other, F.lit(False)),
        }).drop("_n", "_lo", "_hi")

    cold = folded.where(~F.coalesce(bucket.isin(hot), F.lit(False))) if hot else folded
    for i, ks in enumerate(combos):
        together = W.partitionBy(*ks)
        cold = finished(cold.withColumns({n: m.over(together) for n, m in zip(("_n", "_lo", "_hi"), measures)}), i)
    if not hot:
        return cold
    rows = folded.where(bucket.isin(hot))
    salted = rows.withColumn("_id", F.xxhash64(*[k for k in rows.columns]).cast("string"))
    for i, ks in enumerate(combos):
        totals = materialize(rows.groupBy(*ks).agg(
            *[m.alias(n) for n, m in zip(("_n", "_lo", "_hi"), measures)], F.count(F.lit(1)).alias("_size")))
        salted = finished(join_groups(salted, totals, ks, "_size", id_col="_id").drop("_size"), i)
    return cold.unionByName(salted.drop("_id"))


def vote_stats(
    rows: DataFrame, keys: tuple[str, ...] = SIGNATURES, train: str = "train", evaluation: str = "val", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Evaluation rows and pairs agreeing on at least one, and at least two, of three keys.

    Three shuffles of the folded rows, by one key each: every combination is counted where one of its keys lies, the keys
    that are done are left behind, and no row is copied per combination.
    """
    a, b, c = keys
    found = materialize(_folded(rows, list(keys), train, evaluation)).withColumns({
        # Candidates with a sign by inclusion and exclusion, for >= 1 and >= 2 agreeing keys, and what was found so far.
        "union": F.lit(0).cast("long"), "majority": F.lit(0).cast("long"),
        "union_other": F.lit(False), "any": F.lit(False), "two": F.lit(False), "two_other": F.lit(False),
    })
    for combos in ([[c], [c, a], [c, a, b], [c, b]], [[a], [a, b]], [[b]]):
        found = _add_candidates(found, combos, hot_rows)
        for i, ks in enumerate(combos):
            n, other, size = F.col(f"c{i}"), F.col(f"o{i}"), len(ks)
            found = found.withColumns({
                "union": F.col("union") + (-n if size == 2 else n),
                "majority": F.col("majority") + (0 if size == 1 else n if size == 2 else -2 * n),
                "any": F.col("any") | (n > 0),
                "union_other": F.col("union_other") | (other if size == 1 else F.lit(False)),
                "two": F.col("two") | ((n > 0) if size == 2 else F.lit(False)),
                "two_other": F.col("two_other") | (other if size == 2 else F.lit(False)),
            })
        found = found.drop(combos[0][0], *[f"{x}{i}" for i in range(len(combos)) for x in "co"])
    n = F.col("n_eval")
    where = lambda flag: F.sum(F.when(F.col(flag), n))
    total = found.where("n_eval > 0").groupBy().agg(
        where("any").alias("u"), F.sum(_pairs(n, F.col("union"))).alias("up"), where("union_other").alias("uo"),
        where("two").alias("m"), F.sum(_pairs(n, F.col("majority"))).alias("mp"), where("two_other").alias("mo"),
    )

    def row(name: str, *columns: str) -> Column:
        fields = ("evaluation_matched", "pairs", "other_label_matched")
        return F.struct(F.lit(name).alias("votes"), *[
            F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)" if f == "pairs" else "long").alias(f) for c, f in zip(columns, fields)
        ])

    return total.select(
        F.explode(F.array(row("at_least_one", "u", "up", "uo"), row("at_least_two", "m", "mp", "mo"))).alias("r")
    ).select("r.*")

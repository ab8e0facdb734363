"""Agreement of two annotators over the same pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The judgements an annotator may give.
JUDGEMENTS = ("visually_indistinguishable", "near_duplicate", "similar_texture", "different", "uncertain")


def normalised(annotations: DataFrame) -> DataFrame:
    return annotations.select(
        "annotator", F.trim(F.col("pair_id")).alias("pair_id"), F.lower(F.trim("judgement")).alias("judgement")
    )


def judgement_table(annotations: DataFrame) -> DataFrame:
    """One row per pair with both judgements side by side."""
    return normalised(annotations).groupBy("pair_id").agg(
        *[F.max(F.when(F.col("annotator") == a, F.col("judgement"))).alias(f"judgement_{a}") for a in (1, 2)]
    )


def annotator_agreement(judged: DataFrame) -> DataFrame:
    """Observed and expected agreement and Cohen's kappa."""
    cells = judged.groupBy("judgement_1", "judgement_2").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    same = F.when(F.col("judgement_1") == F.col("judgement_2"), F.col("n")).otherwise(zero)
    margins = cells.select(F.explode(F.array(
        F.struct(F.col("judgement_1").alias("label"), F.col("n").alias("a"), zero.alias("b"), same.alias("s")),
        F.struct(F.col("judgement_2").alias("label"), zero.alias("a"), F.col("n").alias("b"), zero.alias("s")),
    )).alias("m")).select("m.*").groupBy("label").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("s").alias("s")
    )
    observed, expected = F.col("observed_agreement"), F.col("expected_agreement")
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    return margins.groupBy().agg(
        F.sum("a").alias("pairs"), (F.sum("s") / F.sum("a")).alias("observed_agreement"),
        (F.sum(a * b) / (F.sum(a) * F.sum(b))).alias("expected_agreement"),
    ).withColumn(
        "cohen_kappa",
        F.when(expected < 1, (observed - expected) / (1 - expected)).otherwise(F.lit(1.0)),
    )


def annotation_violations(annotations: DataFrame, pairs: DataFrame, expected_rows: int | None = None,
                          allowed: tuple[str, ...] = JUDGEMENTS) -> DataFrame:
    """Per annotator: blanks, repeats, unknown words, and ids that differ from the pair table."""
    given = normalised(annotations)
    blank = (F.coalesce("pair_id", F.lit("")) == "") | (F.coalesce("judgement", F.lit("")) == "")
    unknown = ~blank & ~F.col("judgement").isin(*allowed)
    basic = given.groupBy("annotator").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(blank).alias("blank_fields"),
        F.count_if(unknown).alias("unknown_judgements"),
    )
    per_id = given.groupBy("pair_id").agg(
        *[F.count_if(F.col("annotator") == a).alias(f"n{a}") for a in (1, 2)]
    )
    known = pairs.select(F.col("pair_id").cast("string").alias("pair_id")).groupBy("pair_id").agg(
        F.lit(1).alias("in_pairs")
    )
    joined = per_id.join(known, "pair_id", "full").na.fill(0, ["n1", "n2", "in_pairs"])
    ids = joined.groupBy().agg(*[c for a in (1, 2) for c in (
        F.sum(F.greatest(F.col(f"n{a}") - 1, F.lit(0))).alias(f"repeat_{a}"),
        F.count_if((F.col(f"n{a}") > 0) & (F.col("in_pairs") == 0)).alias(f"extra_{a}"),
        F.count_if((F.col(f"n{a}") == 0) & (F.col("in_pairs") == 1)).alias(f"missing_{a}"),
    )]).select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("annotator"), F.col(f"repeat_{a}").alias("repeated_pair_ids"),
                 F.col(f"extra_{a}").alias("ids_not_in_pairs"), F.col(f"missing_{a}").alias("pairs_not_judged"))
        for a in (1, 2)
    ])).alias("r")).select("r.*")
    table = basic.join(ids, "annotator")
    if expected_rows is not None:
        table = table.withColumn("row_count_differs", F.abs(F.col("rows") - expected_rows))
    return table


def strata_predicates() -> dict[str, str]:
    """Overlapping groups of pairs, as conditions on the pair table."""
    return {
        "all_hash_candidates": "sample_kind = 'candidate'",
        "ahash_only": "hash_mask = 1",
        "dhash_only": "hash_mask = 2",
        "phash_only": "hash_mask = 4",
        "exactly_two_hashes": "hash_mask in (3, 5, 6)",
        "all_three_hashes": "hash_mask = 7",
        "no_hash_controls": "sample_kind = 'nonmatching_control'",
    }


def in_groups(pairs: DataFrame, predicates: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per (group, pair) for every predicate the pair satisfies."""
    member = F.array_compact(F.array(*[F.when(F.expr(p), F.lit(n)) for n, p in predicates.items()]))
    return pairs.select(F.explode(member).alias("pair_group"), *keep)


def annotation_strata(judged: DataFrame, pairs: DataFrame, allowed: tuple[str, ...] = JUDGEMENTS) -> DataFrame:
    """Judgement counts of both annotators in each group of pairs."""
    joined = pairs.join(judged, "pair_id")
    columns = ["judgement_1", "judgement_2"]
    return in_groups(joined, strata_predicates(), columns).groupBy("pair_group").agg(
        F.count(F.lit(1)).alias("pairs"),
        *[F.count_if(F.col(f"judgement_{a}") == j).alias(f"{j}_{a}") for j in allowed for a in (1, 2)],
    )


def disagreements(judged: DataFrame) -> DataFrame:
    return judged.where("judgement_1 != judgement_2")

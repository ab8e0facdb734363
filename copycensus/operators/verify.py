"""Checks of stored tables against row-level data, each as a table of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copycensus.functions.identity import digest, unsafe_path
from copycensus.operators.scores import close


def merge_check(source: DataFrame, hashes: DataFrame) -> DataFrame:
    """Counts of ids on one side only and of labels or digests that disagree."""
    a = source.select("sample_id", *[F.col(c).alias(f"a_{c}") for c in ("class_label", "file_sha256", "rgb_sha256")])
    b = hashes.select("sample_id", *[F.col(c).alias(f"b_{c}") for c in ("class_label", "file_sha256", "rgb_sha256")])
    both = F.col("a_class_label").isNotNull() & F.col("b_class_label").isNotNull()
    differs = lambda c: both & (F.col(f"a_{c}") != F.col(f"b_{c}"))
    return a.join(b, "sample_id", "full").groupBy().agg(
        F.count_if(both).alias("matched"),
        F.count_if(F.col("b_class_label").isNull()).alias("only_in_source"),
        F.count_if(F.col("a_class_label").isNull()).alias("only_in_hashes"),
        F.count_if(differs("class_label")).alias("label_mismatches"),
        F.count_if(differs("file_sha256") | differs("rgb_sha256")).alias("digest_mismatches"),
    )


def checked_merge(source: DataFrame, hashes: DataFrame, add: list[str]) -> DataFrame:
    """Join the hash columns to the source manifest after the merge check passes."""
    found = merge_check(source, hashes).first().asDict()
    bad = {k: v for k, v in found.items() if k != "matched" and v}
    if bad:
        raise ValueError("Manifests disagree: " + ", ".join(f"{k}={v}" for k, v in bad.items()))
    return source.join(hashes.select("sample_id", *add), "sample_id")


def index_violations(index: DataFrame, required: DataFrame) -> DataFrame:
    """Repeated ids in the index and required ids it lacks."""
    seen = index.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    need = required.select("sample_id").distinct()
    return need.withColumn("_need", F.lit(1)).join(seen, "sample_id", "full").groupBy().agg(
        F.sum(F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0))).alias("repeated_ids"),
        F.count_if(F.col("_need").isNotNull() & F.col("n").isNull()).alias("missing_ids"),
    )


def content_drift(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Manifest rows whose file is gone or has another digest."""
    frozen = manifest.select("sample_id", "file_sha256").dropDuplicates(["sample_id"])
    now = current.select("sample_id", F.col("file_sha256").alias("current_sha256"))
    return frozen.join(now, "sample_id", "left").where(
        F.col("current_sha256").isNull() | (F.col("current_sha256") != F.col("file_sha256"))
    ).select("sample_id", F.when(F.col("current_sha256").isNull(), "missing").otherwise("changed").alias("problem"))


def membership_drift(current: DataFrame, frozen: DataFrame) -> DataFrame:
    """Ids present on one side only."""
    a = current.select("sample_id").distinct().withColumn("_c", F.lit(1))
    b = frozen.select("sample_id").distinct().withColumn("_f", F.lit(1))
    return a.join(b, "sample_id", "full").where(F.col("_c").isNull() | F.col("_f").isNull()).select(
        "sample_id", F.when(F.col("_c").isNull(), "removed").otherwise("added").alias("change")
    )


def unsafe_paths(manifest: DataFrame) -> DataFrame:
    return manifest.where(unsafe_path("sample_id")).select("sample_id")


def artifact_drift(runs: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded artifact digests (a map of name to digest) that no file matches."""
    recorded = runs.select(*keys, F.explode("artifacts_sha256").alias("name", "recorded"))
    return recorded.join(files, [*keys, "name"], "left").where(
        F.col("sha256").isNull() | (F.col("sha256") != F.col("recorded"))
    ).select(*keys, "name")


def run_completeness(runs: DataFrame, conditions: list[str], seeds: list[int], by: list[str] | None = None) -> DataFrame:
    """Expected (condition, seed) runs that are missing, in each group of ``by``, and runs nobody expected."""
    by = by or []
    keys = [*by, "condition", "seed"]
    groups = runs.select(*by).distinct() if by else runs.sparkSession.range(1)
    expected = (
        groups.select(*by, F.explode(F.array(*[F.lit(c) for c in conditions])).alias("condition"))
        .select(*by, "condition", F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])).alias("seed"))
    )
    found = runs.select(*by, "condition", F.col("seed").cast("long").alias("seed")).distinct()
    side = expected.withColumn("_e", F.lit(1)).join(found.withColumn("_r", F.lit(1)), keys, "full")
    return side.where(F.col("_e").isNull() | F.col("_r").isNull()).select(
        *keys, F.when(F.col("_r").isNull(), "missing").otherwise("extra").alias("problem")
    )


def paired_start_check(runs: DataFrame, by: list[str]) -> DataFrame:
    """Distinct initial states per pairing; a valid pairing has exactly one."""
    return runs.groupBy(*by, "initial_state_sha256").agg(F.count(F.lit(1)).alias("runs")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("initial_states"), F.sum("runs").alias("runs")
    )


def snapshot_agreement(audits: DataFrame) -> DataFrame:
    """Distinct snapshot ids over all audits; more than one means they saw different data."""
    return audits.groupBy("dataset_snapshot_sha256").agg(F.count(F.lit(1)).alias("audits")).groupBy().agg(
        F.count(F.lit(1)).alias("snapshots"), F.sum("audits").alias("audits")
    )


def fraction_violations(table: DataFrame, fraction: str, part: str, whole: str, tolerance: float = 1e-12) -> DataFrame:
    """Rows whose stored fraction is not the quotient of the stored counts."""
    return table.where(F.abs(F.col(fraction) - F.col(part) / F.col(whole)) >= tolerance)


def claim_check(found: DataFrame, expected: DataFrame, digits: int = 2) -> DataFrame:
    """Expected values beside recomputed ones, rounded alike; missing claims fail."""
    a = expected.select("claim", F.col("value").cast("double").alias("expected"))
    b = found.select("claim", F.bround(F.col("value").cast("double"), digits).alias("found"))
    same = F.coalesce(F.bround(F.col("expected"), digits) == F.col("found"), F.lit(False))
    return a.join(b, "claim", "left").withColumn("holds", same.cast("int"))


def sign_claims(contrasts: DataFrame, by: list[str]) -> DataFrame:
    """Whether all seed differences are positive, or straddle zero."""
    low, high = F.min("difference_pp"), F.max("difference_pp")
    return contrasts.groupBy(*by).agg(
        (low > 0).cast("int").alias("all_positive"), ((low < 0) & (high > 0)).cast("int").alias("straddles_zero")
    )


def settings_differences(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Names whose values differ between two (name, value) tables."""
    a = stored.select("name", F.col("value").alias("stored"))
    b = current.select("name", F.col("value").alias("current"))
    return a.join(b, "name", "full").where(~F.col("stored").eqNullSafe(F.col("current")))


def decision_differences(recomputed: DataFrame, stored: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of a stored decision that the recomputed one does not reproduce."""
    def same(c: str) -> Column:
        a, b = F.col(f"r_{c}"), F.col(f"s_{c}")
        return close(a, b) if dict(recomputed.dtypes)[c] in ("double", "float") else a.eqNullSafe(b)

    a = recomputed.select(*keys, F.lit(1).alias("_r"), *[F.col(c).alias(f"r_{c}") for c in columns])
    b = stored.select(*keys, F.lit(1).alias("_s"), *[F.col(c).alias(f"s_{c}") for c in columns])
    bad = reduce(lambda x, y: x | y, [~same(c) for c in columns], F.lit(False))
    return a.join(b, keys, "full").where(F.col("_r").isNull() | F.col("_s").isNull() | bad).select(
        *keys, F.when(F.col("_s").isNull(), "not stored").when(F.col("_r").isNull(), "not derived")
        .otherwise("differs").alias("problem")
    )


def _sealed(rows: DataFrame, line: Column, spread_by: Column, digits: int = 4, levels: int = 3) -> DataFrame:
    """Digest tree of ordered, distinct lines: leaves of ``levels * digits`` hash digits, then fewer digits per level.

    A node above the leaves has at most 16**digits children, and 16**(levels * digits) leaves are more than there are
    lines, so no task gathers what grows with the table.
    """
    nodes = rows.select(
        F.substring(spread_by, 1, levels * digits).alias("bucket"), line.alias("line"), F.col("copies")
    ).groupBy("bucket").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ""), 256).alias("sealed"),
        F.sum("copies").alias("n"),
    )
    children = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "sealed"))), "\n"), 256)
    for level in range(levels - 1, 0, -1):
        nodes = nodes.groupBy(F.substring("bucket", 1, level * digits).alias("parent")).agg(
            children.alias("sealed"), F.sum("n").alias("n")
        ).withColumnRenamed("parent", "bucket")
    return nodes.groupBy().agg(children.alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def snapshot_digest(rows: DataFrame, content: str = "file_sha256") -> DataFrame:
    """Order-free digest of the (id, content digest) lines of a corpus."""
    line = F.concat(F.lit('["'), "sample_id", F.lit('","'), content, F.lit('"]\n'))
    return _sealed(rows.withColumn("copies", F.lit(1)), line, digest("sample_id"))


def rowset_digest(rows: DataFrame) -> DataFrame:
    """Order-free digest of whole rows, written as JSON with sorted names, and how often each occurs.

    Equal rows are folded first, so copies of one row do not pile up in a bucket.
    """
    row = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(rows.columns)]))
    folded = rows.select(row.alias("j")).groupBy("j").agg(F.count(F.lit(1)).alias("copies"))
    line = F.concat("j", F.lit("*"), F.col("copies").cast("string"), F.lit("\n"))
    return _sealed(folded, line, digest("j"))

"""One DataFrame query per operator of the inventory, over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copycensus.functions.identity import MATCH_METHODS, SIGNATURES, group_id, rule_key, stable_rank
from copycensus.operators import agreement, completeness, contrasts, dedup, exposure, learn, pairs, scores, splits, verify, votes
from copycensus.operators import conditions as cond
from copycensus.operators import value_table as vt
from copycensus.plans import audit, protocol
from copycensus.plans import studies as st
from copycensus.session import materialize
from copycensus.sources import samples

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
METHODS = list(MATCH_METHODS)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Plain output types: longs, rounded doubles, flags as 0/1."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.BooleanType, T.DecimalType)):
            c = c.cast("long")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        columns.append(c.alias(field.name))
    return df.select(*columns)


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[function.__name__] = lambda spark, sf: tidy(function(spark, sf))
    return function


def doc_values(spark: SparkSession, sf: str, label: str = "lang") -> DataFrame:
    return vt.value_table(samples.documents(spark, sf, label), METHODS, vt.split_counts())


def doc_groups(spark: SparkSession, sf: str, label: str) -> tuple[DataFrame, DataFrame]:
    rows = materialize(samples.documents(spark, sf, label))
    return rows, st.consensus_groups(rows)


# Identity and signatures -------------------------------------------------

@query
def identity_digests(spark, sf):
    return samples.documents(spark, sf).select(
        "sample_id", "file_sha256", "rgb_sha256", "input_sha256",
        group_id("exact_input", rule_key("exact_input")).alias("duplicate_group_id"),
        stable_rank(st.REPRESENTATIVE_SEED, F.col("sample_id")).alias("representative_rank"),
        stable_rank(st.SELECT_SEED, F.col("sample_id"), "select").alias("selection_rank"),
    )


@query
def signal_hashes(spark, sf):
    return samples.embeddings(spark, sf).select("sample_id", *SIGNATURES, "hash_consensus")


@query
def text_signatures(spark, sf):
    rows = samples.documents(spark, sf)
    return rows.select(
        "sample_id", *SIGNATURES, "hash_consensus",
        group_id("hash_consensus", rule_key("hash_consensus")).alias("duplicate_group_id"),
    )


# Grouping and redundancy -------------------------------------------------

@query
def value_groups(spark, sf):
    return doc_values(spark, sf)


@query
def global_summary(spark, sf):
    return vt.global_summary(doc_values(spark, sf))


@query
def global_summary_events(spark, sf):
    rows = samples.events(spark, sf)
    return vt.global_summary(vt.value_table(rows, list(samples.EVENT_METHODS)))


@query
def global_summary_lineitem(spark, sf):
    rows = samples.lineitems(spark, sf)
    return vt.global_summary(vt.value_table(rows, list(samples.LINE_METHODS)))


@query
def redundancy_audit(spark, sf):
    """Flagship: redundancy and cross-split overlap per method from one value table."""
    values = materialize(doc_values(spark, sf))
    return vt.global_summary(values).join(vt.cross_split_overlap(values), "method")


@query
def cross_split_overlap(spark, sf):
    return vt.cross_split_overlap(doc_values(spark, sf, "source"))


@query
def cross_split_overlap_events(spark, sf):
    rows = samples.events(spark, sf)
    return vt.cross_split_overlap(vt.value_table(rows, list(samples.EVENT_METHODS), vt.split_counts()))


@query
def per_class_summary(spark, sf):
    return vt.per_class_summary(doc_values(spark, sf, "source"), METHODS, "hash_consensus", 20)


@query
def mixed_label_groups(spark, sf):
    _, groups = doc_groups(spark, sf, "source")
    return dedup.mixed_groups(groups).select(
        "duplicate_group_id", F.col("duplicate_group_size").alias("group_size"),
        F.col("group_class_count").alias("class_count"), F.to_json("classes").alias("classes_json"),
        "distinct_contents", "representative_sample_id", F.col("value").alias("consensus_value"),
    )


@query
def exact_census(spark, sf):
    rows = samples.documents(spark, sf)
    return vt.exact_census(vt.value_table(rows, ["file_sha256", "rgb_sha256", "input_sha256"], vt.split_counts()))


@query
def matched_by_class(spark, sf):
    values = vt.value_table(samples.documents(spark, sf), ["rgb_sha256"], vt.split_counts())
    return vt.matched_by_class(values, "rgb_sha256")


@query
def verify_exact_groups(spark, sf):
    rows = samples.documents_with_text(spark, sf)
    checks = [
        dedup.verify_exact_groups(rows, key, payload).withColumn("method", F.lit(key))
        for key, payload in (("file_sha256", "text"), ("rgb_sha256", "canonical"))
    ]
    return reduce(DataFrame.unionByName, checks)


def _annotated(spark, sf, label="source"):
    rows, groups = doc_groups(spark, sf, label)
    return dedup.annotate(rows, F.col("hash_consensus"), groups)


DEDUP_COLUMNS = ["sample_id", "class_label", "duplicate_group_id", "duplicate_group_size",
                 "representative_sample_id", "group_class_count"]


@query
def dedup_retained(spark, sf):
    return dedup.retained(_annotated(spark, sf)).select(*DEDUP_COLUMNS)


@query
def dedup_removed(spark, sf):
    return dedup.removed(_annotated(spark, sf)).select(*DEDUP_COLUMNS)


@query
def dedup_groups(spark, sf):
    _, groups = doc_groups(spark, sf, "source")
    return groups.select(
        "duplicate_group_id", "duplicate_group_size", "group_class_count",
        F.array_join("classes", ";").alias("classes"), "distinct_contents", "representative_sample_id",
    )


@query
def dedup_exact_fatal(spark, sf):
    """The strict rule: one representative per exact input; ``group_class_count`` above 1 marks a conflict, which ``dedup.require_pure`` makes fatal."""
    rows = materialize(samples.documents(spark, sf).select("sample_id", "class_label", "input_sha256"))
    groups = materialize(
        dedup.duplicate_groups(rows, rule_key("exact_input"), "exact_input", st.REPRESENTATIVE_SEED, null_label=False)
    )
    return dedup.retained(dedup.annotate(rows, rule_key("exact_input"), groups)).select(*DEDUP_COLUMNS)


@query
def dedup_conflicts(spark, sf):
    rows, groups = doc_groups(spark, sf, "source")
    examples = dedup.conflict_examples(rows, F.col("hash_consensus"), groups)
    return examples.select("value", F.array_join("examples", ";").alias("examples"))


@query
def safe_pool(spark, sf):
    return _annotated(spark, sf).where("group_class_count = 1").select(*DEDUP_COLUMNS)


@query
def pure_representatives(spark, sf):
    rows, groups = doc_groups(spark, sf, "source")
    eligible = materialize(dedup.eligible_classes(rows, groups, 10).where("eligible = 1").select("class_label"))
    pure = dedup.annotate(rows, F.col("hash_consensus"), groups).where("group_class_count = 1 and is_representative")
    return pure.join(eligible, "class_label", "left_semi").select(*DEDUP_COLUMNS)


@query
def eligible_classes(spark, sf):
    rows, groups = doc_groups(spark, sf, "source")
    return dedup.eligible_classes(rows, groups, 20)


@query
def eligible_classes_pure_universe(spark, sf):
    rows, groups = doc_groups(spark, sf, "source")
    return dedup.eligible_classes(rows, groups, 20, universe="pure")


@query
def insufficient_classes(spark, sf):
    counts = dedup.retained(_annotated(spark, sf, "lang")).groupBy("class_label").agg(
        F.count(F.lit(1)).alias("retained_groups")
    )
    return dedup.insufficient_classes(counts, 120, exclude=True)


@query
def conservative_cleaning(spark, sf):
    values = vt.value_table(samples.documents(spark, sf, "source"), ["hash_consensus"])
    return dedup.conservative_cleaning(dedup.class_groups(values, "hash_consensus"), 22)


@query
def post_dedup_class_table(spark, sf):
    rows = materialize(samples.documents(spark, sf).select("sample_id", "class_label", "input_sha256"))
    groups = materialize(
        dedup.duplicate_groups(rows, rule_key("exact_input"), "exact_input", st.REPRESENTATIVE_SEED, null_label=False)
    )
    annotated = materialize(dedup.annotate(rows, rule_key("exact_input"), groups))
    manifest = splits.stratified_split(dedup.retained(annotated), seed=st.SPLIT_SEED, clamped=True)
    return dedup.class_table(annotated, manifest)


@query
def dataset_overview(spark, sf):
    columns = ["sample_id", "class_label"]
    parts = [
        samples.documents(spark, sf).select(
            F.lit("documents").alias("dataset"), *columns, F.col("rgb_sha256").alias("exact"),
            F.col("hash_consensus").alias("tuple")),
        samples.events(spark, sf).select(
            F.lit("events").alias("dataset"), *columns, F.col("user_type_props").alias("exact"),
            F.col("user_type").alias("tuple")),
        samples.lineitems(spark, sf).select(
            F.lit("lineitem").alias("dataset"), *columns, F.col("part_supplier").alias("exact"),
            F.col("part").alias("tuple")),
    ]
    return dedup.dataset_overview(reduce(DataFrame.unionByName, parts), "exact", "tuple", 150)


# Splits --------------------------------------------------------------------

@query
def stratified_split(spark, sf):
    return splits.stratified_split(samples.documents(spark, sf).select("sample_id", "class_label"), seed=st.SPLIT_SEED)


@query
def stratified_split_events(spark, sf):
    return splits.stratified_split(samples.events(spark, sf).select("sample_id", "class_label"), seed=st.SPLIT_SEED)


@query
def stratified_split_lineitem(spark, sf):
    # The id is a digest of the whole row: write it once instead of hashing per pass.
    rows = materialize(samples.lineitems(spark, sf).select("sample_id", "class_label"))
    return splits.stratified_split(rows, seed=st.SPLIT_SEED)


@query
def clamped_split(spark, sf):
    rows = samples.documents(spark, sf, "source").select("sample_id", "class_label")
    return splits.stratified_split(rows, 0.7, 0.2, st.SPLIT_SEED, clamped=True)


@query
def split_80_20(spark, sf):
    return splits.two_way_split(samples.events(spark, sf).select("sample_id", "class_label"))


@query
def group_development_split(spark, sf):
    rows = materialize(samples.documents(spark, sf).select("sample_id", "class_label", "original_split", "input_sha256"))
    return splits.group_development_split(rows, strict=False).select("sample_id", "class_label", "partition")


@query
def protocol_summary(spark, sf):
    """Metadata row of the full and clean protocols, lists joined into text."""
    rows = materialize(samples.documents(spark, sf, "source").select(
        "sample_id", "class_label", "rgb_sha256", "hash_consensus"
    ))
    safe, classes = st.safe_pool(rows, 20)
    table = protocol.pair_metadata(rows, st.consensus_groups(rows), classes, safe)
    return table.withColumns({c: F.array_join(c, ";") for c in ("eligible_classes", "excluded_classes")})


@query
def audit_metadata(spark, sf):
    """Metadata row of a whole audit, lists and maps written as text."""
    rows, groups = doc_groups(spark, sf, "source")
    classes = vt.per_class_summary(vt.value_table(rows, METHODS), METHODS, "hash_consensus", 22)
    table = audit.audit_metadata(rows, groups, classes, 22, st.REPRESENTATIVE_SEED)
    return table.withColumns({
        "classes_below_minimum": F.array_join("classes_below_minimum", ";"),
        "original_split_counts": F.to_json("original_split_counts"),
    })


@query
def split_violations(spark, sf):
    rows = materialize(samples.documents(spark, sf).select(
        "sample_id", "class_label", "original_split", "rgb_sha256", "input_sha256"
    ))
    split = materialize(splits.group_development_split(rows, strict=False))
    return splits.split_violations(
        split, ["rgb_sha256", "input_sha256"], evaluation_split="val", splits=["train", "val"]
    )


@query
def clean_split_violations(spark, sf):
    rows = materialize(samples.documents(spark, sf).select("sample_id", "class_label", "input_sha256"))
    groups = materialize(
        dedup.duplicate_groups(rows, rule_key("exact_input"), "exact_input", st.REPRESENTATIVE_SEED, null_label=False)
    )
    clean = dedup.retained(dedup.annotate(rows, rule_key("exact_input"), groups))
    split = materialize(splits.stratified_split(clean, seed=st.SPLIT_SEED))
    return splits.split_violations(split, ["input_sha256"], disjoint_group="duplicate_group_id")


@query
def protocol_pair(spark, sf):
    rows = materialize(samples.documents(spark, sf, "source").select(
        "sample_id", "class_label", "rgb_sha256", "hash_consensus"
    ))
    full, clean = st.protocol_pair(rows, 5, clamped=True)
    return (
        full.select(F.lit("full").alias("protocol"), "class_label", "partition")
        .unionByName(clean.select(F.lit("clean").alias("protocol"), "class_label", "partition"))
        .groupBy("protocol", "class_label", "partition").agg(F.count(F.lit(1)).alias("images"))
    )


# Conditions and exposure ---------------------------------------------------

@query
def partition_overlap(spark, sf):
    split = st.exact_manifest(spark, sf)
    values = vt.value_table(split, ["file_sha256", "rgb_sha256", "input_sha256"], vt.partition_counts())
    return vt.partition_overlap(values)


@query
def class_partition_counts(spark, sf):
    keys = ["file_sha256", "rgb_sha256", "input_sha256"]
    return vt.class_partition_counts(vt.value_table(st.exact_manifest(spark, sf), keys, vt.partition_counts()), keys)


@query
def class_exposure_global(spark, sf):
    keys = ["rgb_sha256", "input_sha256"]
    values = vt.value_table(st.exact_manifest(spark, sf), keys, vt.partition_counts())
    return vt.class_partition_counts(values, keys, keys)


@query
def paired_conditions(spark, sf):
    return st.paired(spark, sf).select(
        "sample_id", "class_label", "partition", "exposed", "in_clean", "in_control"
    )


@query
def eval_only_conditions(spark, sf):
    marked = cond.paired_conditions(
        st.exact_manifest(spark, sf), "rgb_sha256", held_out=("evaluation",), seed=st.REMOVAL_SEED,
        require_exposure=False,
    )
    return marked.select("sample_id", "class_label", "partition", "exposed", "in_clean", "in_control")


@query
def condition_violations(spark, sf):
    return cond.condition_violations(st.paired(spark, sf), "input_sha256", ("development", "evaluation"))


@query
def condition_exposure(spark, sf):
    return exposure.condition_exposure(st.paired(spark, sf), "input_sha256")


@query
def condition_exposure_global(spark, sf):
    marked = cond.paired_conditions(
        st.exact_manifest(spark, sf), "rgb_sha256", held_out=("evaluation",), seed=st.REMOVAL_SEED,
        require_exposure=False,
    )
    return exposure.condition_exposure_global(marked, {"rgb_sha256": "native", "input_sha256": "input"})


@query
def removed_attribution(spark, sf):
    return exposure.removed_attribution(st.paired(spark, sf))


@query
def class_exposure_report(spark, sf):
    return exposure.class_exposure_report(st.paired(spark, sf), "input_sha256")


@query
def scope_summary(spark, sf):
    return exposure.scope_summary(st.paired(spark, sf), "input_sha256")


@query
def reconstruct_check(spark, sf):
    marked = materialize(st.paired(spark, sf))
    full = marked.where("partition = 'fitting'")
    return exposure.reconstruct_check(marked, full, full.where("in_clean"), full.where("exposed"))


@query
def matched_subsample(spark, sf):
    table = st.four_conditions(spark, sf)
    return table.where("random_subsample is not null").select("sample_id", "class_label", F.col("random_subsample").alias("partition"))


@query
def condition_summary(spark, sf):
    return exposure.condition_summary(st.four_conditions(spark, sf), st.FOUR)


@query
def condition_class_counts(spark, sf):
    return exposure.condition_class_counts(st.four_conditions(spark, sf), st.FOUR)


@query
def exposure_fractions(spark, sf):
    return exposure.exposure_fractions(exposure.condition_summary(st.four_conditions(spark, sf), st.FOUR))


@query
def condition_parity(spark, sf):
    table = materialize(st.four_conditions(spark, sf))
    sides = [
        table.where(F.col(name).isNotNull()).select("class_label", F.col(name).alias("partition"))
        for name in ("random_subsample", "clean_consensus")
    ]
    differing = splits.count_parity(*sides, ["class_label", "partition"])
    return differing.groupBy().agg(F.count(F.lit(1)).alias("differing_strata"))


@query
def method_class_overlap(spark, sf):
    return vt.method_class_overlap(doc_values(spark, sf, "source"))


@query
def method_class_overlap_wide(spark, sf):
    keys = ["rgb_sha256", "phash", "hash_consensus"]
    values = vt.value_table(samples.documents(spark, sf, "source"), keys, vt.split_counts())
    return vt.overlap_by_class_wide(vt.method_class_overlap(values), keys)


@query
def hash_pair_stats(spark, sf):
    keysets = {"ahash": ["ahash"], "dhash": ["dhash"], "phash": ["phash"], "all_three": list(SIGNATURES)}
    return votes.key_pair_stats(samples.documents(spark, sf, "source"), keysets)


@query
def hash_vote_stats(spark, sf):
    return votes.vote_stats(samples.documents(spark, sf, "source"))


@query
def key_vote_stats_lineitem(spark, sf):
    rows = samples.lineitems(spark, sf)
    return votes.vote_stats(rows, ("part_supplier", "part_quantity", "part"))


# Scores --------------------------------------------------------------------

@query
def nearest_centroid_predictions(spark, sf):
    found = learn.nearest_centroid(st.embedding_conditions(spark, sf), 64)
    return found.select("condition", "sample_id", "true_label", "predicted_label", "distance")


@query
def study_predictions(spark, sf):
    return st.study_runs(spark, sf).predictions(st.RUN)


@query
def study_selection(spark, sf):
    return st.study_runs(spark, sf).selection_table(st.RUN)


@query
def prediction_violations(spark, sf):
    found = learn.nearest_centroid(st.embedding_conditions(spark, sf), 64)
    return scores.prediction_violations(found, ["condition"], st.LABELS)


@query
def mean_log_loss(spark, sf):
    found = learn.nearest_centroid(st.embedding_conditions(spark, sf), 64)
    return scores.mean_log_loss(found, ["condition"], st.LABELS)


@query
def ml_condition_scores(spark, sf):
    """Regression per condition; only the given conditions differ in their fitting rows."""
    table = st.embedding_conditions(spark, sf)
    found = {
        c: learn.regression_scores(table.where(F.col("condition") == c), st.LABELS).drop("probabilities")
        for c in ("full", "clean_exact", "random_control")
    }
    scored = scores.class_scores(learn.union_conditions(found), ["condition"], st.LABELS)
    return scores.overall_scores(scored, ["condition"])


@query
def confusion_matrix(spark, sf):
    return scores.confusion_matrix(st.predictions(spark, sf), st.RUN, st.LABELS)


@query
def confusion_wide(spark, sf):
    return scores.confusion_wide(st.predictions(spark, sf), st.RUN, st.LABELS)


@query
def class_scores(spark, sf):
    return st.class_scores(spark, sf).drop("hits")


@query
def overall_scores(spark, sf):
    return scores.overall_scores(st.class_scores(spark, sf), st.RUN)


@query
def class_weights(spark, sf):
    return scores.class_weights(samples.events(spark, sf))


@query
def best_epoch(spark, sf):
    return scores.best_epoch(st.history(spark, sf), ["recipe_name"])


@query
def recipe_summary(spark, sf):
    return scores.recipe_summary(st.tuning_results(spark, sf))


@query
def recipe_selection(spark, sf):
    return scores.select_recipe(st.tuning_results(spark, sf))


@query
def label_index(spark, sf):
    return scores.label_index(samples.documents(spark, sf, "source")).drop("n")


@query
def score_recompute(spark, sf):
    """Checks the stored scores of every run; two stored values are off on purpose."""
    predictions = materialize(st.predictions(spark, sf))
    classes = scores.class_scores(predictions, st.RUN, st.LABELS)
    first = (F.col("seed") == st.SEEDS[0]) & (F.col("condition") == "full")
    stored = scores.overall_scores(classes, st.RUN).withColumn(
        "accuracy", F.when(first, F.col("accuracy") + 0.001).otherwise(F.col("accuracy"))
    )
    confusion = scores.confusion_matrix(predictions, st.RUN, st.LABELS).withColumn(
        "n", F.when(first & (F.col("true_label") == "3") & (F.col("predicted_label") == "3"), F.col("n") + 1)
        .otherwise(F.col("n"))
    )
    return scores.score_violations(predictions, stored, classes, confusion, st.RUN, st.LABELS)


# Contrasts -----------------------------------------------------------------

def _contrasts(spark, sf):
    return contrasts.seed_contrasts(materialize(st.run_metrics(spark, sf)), st.CONTRASTS)


@query
def results_union(spark, sf):
    return contrasts.results_union(st.run_metrics(spark, sf))


@query
def seed_contrasts(spark, sf):
    return _contrasts(spark, sf)


@query
def seed_contrasts_wide(spark, sf):
    return contrasts.seed_contrasts_wide(_contrasts(spark, sf), list(st.CONTRASTS))


@query
def metric_summary(spark, sf):
    return contrasts.metric_summary(st.run_metrics(spark, sf), ["condition"])


@query
def contrast_summary(spark, sf):
    return contrasts.contrast_summary(_contrasts(spark, sf)).drop("seed_values_pp")


@query
def contrast_summary_tabulated(spark, sf):
    return contrasts.contrast_summary(_contrasts(spark, sf), critical="tabulated").drop("seed_values_pp")


@query
def sign_claims(spark, sf):
    return verify.sign_claims(_contrasts(spark, sf), ["contrast", "metric"])


@query
def class_recall_contrast(spark, sf):
    return contrasts.class_metric_contrast(st.class_scores(spark, sf), [], "random_control", "clean_exact")


@query
def study_aggregate(spark, sf):
    return contrasts.study_aggregate(st.run_metrics(spark, sf), ["condition"])


@query
def contrast_extremes(spark, sf):
    summary = contrasts.contrast_summary(_contrasts(spark, sf))
    return summary.where("metric = 'accuracy'").groupBy("contrast").agg(
        F.min("mean_pp").alias("minimum_mean_pp"), F.max("mean_pp").alias("maximum_mean_pp")
    )


def _study_summary(spark, sf):
    found = contrasts.seed_contrasts(materialize(st.study_metrics(spark, sf)), st.CONTRASTS, ["study"])
    return contrasts.contrast_summary(found, ["study"])


@query
def study_results(spark, sf):
    return contrasts.study_aggregate(st.study_metrics(spark, sf), ["study", "condition"])


@query
def study_contrasts(spark, sf):
    return _study_summary(spark, sf).drop("seed_values_pp")


@query
def study_contrast_extremes(spark, sf):
    return contrasts.contrast_extremes(_study_summary(spark, sf))


# Agreement and pairs ---------------------------------------------------------

@query
def annotator_agreement(spark, sf):
    return agreement.annotator_agreement(agreement.judgement_table(st.annotations(spark, sf)))


@query
def annotation_violations(spark, sf):
    known = samples.table(spark, sf, "documents").select(F.col("doc_id").alias("pair_id"))
    return agreement.annotation_violations(st.annotations(spark, sf), known)


@query
def annotation_strata(spark, sf):
    judged = agreement.judgement_table(st.annotations(spark, sf))
    return agreement.annotation_strata(judged, st.pair_table(spark, sf))


@query
def annotation_disagreements(spark, sf):
    return agreement.disagreements(agreement.judgement_table(st.annotations(spark, sf)))


@query
def pair_masks(spark, sf):
    return st.pair_table(spark, sf)


@query
def pair_metric_summary(spark, sf):
    return pairs.pair_metric_summary(st.pair_table(spark, sf))


@query
def empirical_cdf(spark, sf):
    return pairs.empirical_cdf(st.pair_table(spark, sf), "difference")


@query
def stratum_counts(spark, sf):
    return pairs.stratum_counts(st.pair_table(spark, sf))


@query
def removal_ranking(spark, sf):
    classes = _annotated(spark, sf).groupBy("class_label").agg(
        F.count_if("is_representative").alias("retained_groups"),
        (100 * F.count_if(~F.col("is_representative")) / F.count(F.lit(1))).alias("removed_percent"),
    )
    return pairs.removal_ranking(classes, 25)


# Verification ----------------------------------------------------------------

@query
def manifest_merge_check(spark, sf):
    """The split manifest against the hash manifest of the same corpus."""
    rows = materialize(samples.documents(spark, sf).select(
        "sample_id", "class_label", "file_sha256", "rgb_sha256", "ahash", "dhash", "phash"
    ))
    source = splits.stratified_split(rows.select("sample_id", "class_label", "file_sha256", "rgb_sha256"), seed=st.SPLIT_SEED)
    return verify.merge_check(source, rows)


@query
def index_check(spark, sf):
    rows = samples.documents(spark, sf).select("sample_id")
    needed = samples.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("sample_id"))
    return verify.index_violations(rows, needed)


@query
def content_drift(spark, sf):
    """Documents against the reference digests of their canonical form, as if that were the frozen file."""
    rows = materialize(samples.documents(spark, sf).select("sample_id", "file_sha256", "rgb_sha256"))
    frozen = rows.select("sample_id", F.col("rgb_sha256").alias("file_sha256"))
    return verify.content_drift(frozen, rows)


@query
def membership_drift(spark, sf):
    """Documents against the labelled subset."""
    labelled = samples.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("sample_id"))
    rows = samples.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("sample_id"))
    return verify.membership_drift(rows, labelled)


@query
def run_completeness(spark, sf):
    return verify.run_completeness(st.run_metrics(spark, sf), ["full", "clean_exact", "random_subsample"], [*st.SEEDS, 1])


@query
def paired_start_check(spark, sf):
    return verify.paired_start_check(st.run_metrics(spark, sf), ["seed"])


@query
def run_gaps(spark, sf):
    """Runs that a user's events lack, expected from the types and weekdays of all events."""
    return completeness.run_gaps(st.event_steps(spark, sf), ["study"])


@query
def unpaired_starts(spark, sf):
    """Whether all conditions of a user's weekday began with the same properties."""
    runs = completeness.first_states(st.event_steps(spark, sf), ["study", "seed", "condition"], ["ts", "event_id"], "props")
    return completeness.unpaired_starts(runs, ["study", "seed"])


@query
def claim_check(spark, sf):
    """Published-style claims recomputed from the corpus; the last one is wrong on purpose."""
    values = vt.value_table(samples.documents(spark, sf), ["file_sha256", "rgb_sha256"])
    found = vt.global_summary(values).select(
        F.concat("method", F.lit("_excess")).alias("claim"), F.col("excess_copies").cast("double").alias("value")
    )
    rows = samples.table(spark, sf, "documents").select(F.sha2("text", 256).alias("d")).groupBy("d").agg(
        F.count(F.lit(1)).alias("n")
    ).groupBy().agg(F.sum(F.col("n") - 1).cast("double").alias("value"))
    expected = rows.select(F.explode(F.array(
        F.struct(F.lit("file_sha256_excess").alias("claim"), F.col("value").alias("value")),
        F.struct(F.lit("rgb_sha256_excess").alias("claim"), (F.col("value") + 1).alias("value")),
    )).alias("e")).select("e.*")
    return verify.claim_check(found, expected)


@query
def fraction_check(spark, sf):
    """Stored overlap fractions that do not follow from their counts: none, with one spoiled row."""
    stored = vt.cross_split_overlap(doc_values(spark, sf)).withColumn(
        "evaluation_overlap_fraction",
        F.col("evaluation_overlap_fraction") + F.when(F.col("method") == "ahash", 1e-6).otherwise(0.0),
    )
    return verify.fraction_violations(
        stored, "evaluation_overlap_fraction", "evaluation_matched", "evaluation_images"
    ).select("method")


@query
def protocol_reuse_check(spark, sf):
    """A frozen manifest may be reused: constraints, membership, paths, digests and content hold."""
    rows = materialize(samples.documents(spark, sf).select(
        "sample_id", "class_label", "original_split", "file_sha256", "rgb_sha256", "input_sha256"
    ))
    frozen = materialize(splits.stratified_split(rows, seed=st.SPLIT_SEED))
    again = splits.stratified_split(rows, seed=st.SPLIT_SEED)
    counted = lambda name, df: df.groupBy().agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(name).alias("check"), "violations"
    )
    columns = ["sample_id", "class_label", "partition", "file_sha256"]
    seals = verify.rowset_digest(frozen.select(*columns)).unionByName(verify.rowset_digest(again.select(*columns)))
    parts = [
        splits.split_violations(frozen, splits=["train", "val"]),
        counted("membership_drift", verify.membership_drift(rows, frozen)),
        counted("unsafe_paths", verify.unsafe_paths(frozen)),
        counted("content_drift", verify.content_drift(frozen, rows)),
        seals.groupBy().agg((F.count_distinct("digest") - 1).alias("violations")).select(
            F.lit("manifest_digest").alias("check"), "violations"
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def selection_recheck(spark, sf):
    """The stored choice of recipe against the one derived again; one stored score is spoiled."""
    derived = materialize(scores.recipe_summary(st.tuning_results(spark, sf)))
    stored = derived.withColumn(
        "mean_development_loss",
        F.col("mean_development_loss") + F.when(F.col("recipe_name") == "view", 0.01).otherwise(0.0),
    )
    return verify.decision_differences(
        derived, stored, ["recipe_name"], ["mean_development_loss", "mean_development_accuracy", "runs"]
    )


@query
def settings_check(spark, sf):
    """Class sizes recorded by one study against another's label space."""
    a = samples.events(spark, sf).groupBy("class_label").agg(F.count(F.lit(1)).cast("string").alias("value"))
    b = samples.events(spark, sf).where("original_split = 'train' or class_label = 'click'").groupBy("class_label").agg(
        F.count(F.lit(1)).cast("string").alias("value")
    )
    name = F.col("class_label").alias("name")
    return verify.settings_differences(a.select(name, "value"), b.select(name, "value"))


@query
def snapshot_digest(spark, sf):
    return verify.snapshot_digest(samples.documents(spark, sf))


@query
def rowset_digest(spark, sf):
    rows = samples.documents(spark, sf).select("sample_id", "class_label", "original_split", "rgb_sha256")
    return verify.rowset_digest(rows)


@query
def snapshot_agreement(spark, sf):
    """Two audits of one corpus, and one of its canonical form, by their snapshot digests."""
    rows = materialize(samples.documents(spark, sf).select("sample_id", "file_sha256", "rgb_sha256"))
    audits = [verify.snapshot_digest(rows), verify.snapshot_digest(rows), verify.snapshot_digest(rows, "rgb_sha256")]
    table = reduce(DataFrame.unionByName, audits)
    return verify.snapshot_agreement(table.select(F.col("digest").alias("dataset_snapshot_sha256")))

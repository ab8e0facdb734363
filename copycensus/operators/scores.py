"""Confusion counts, class scores and run selection from prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("accuracy", "macro_f1", "macro_recall")


def _labels(classes: list[str]) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def confusion_counts(predictions: DataFrame, runs: list[str]) -> DataFrame:
    """Observed (true, predicted) counts per run."""
    return predictions.groupBy(*runs, "true_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, runs: list[str], classes: list[str]) -> DataFrame:
    """Every (true, predicted) cell of the declared classes, zeros included."""
    counts = confusion_counts(predictions, runs)
    cells = (
        counts.select(*runs).distinct()
        .withColumn("true_label", F.explode(_labels(classes)))
        .withColumn("predicted_label", F.explode(_labels(classes)))
    )
    return cells.join(counts, [*runs, "true_label", "predicted_label"], "left").na.fill(0, ["n"])


def confusion_wide(predictions: DataFrame, runs: list[str], classes: list[str]) -> DataFrame:
    """One row per true class with a count column per predicted class."""
    return confusion_matrix(predictions, runs, classes).groupBy(
        *runs, F.col("true_label").alias("true_class")
    ).agg(*[F.sum(F.when(F.col("predicted_label") == c, F.col("n")).otherwise(0)).alias(c) for c in classes])


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_scores(predictions: DataFrame, runs: list[str], classes: list[str]) -> DataFrame:
    """Support, precision, recall and F1 of every declared class; 0 where undefined."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(zero)
    sides = F.explode(F.array(
        F.struct(F.col("true_label").alias("class_label"), F.col("n").alias("s"), zero.alias("p"), hit.alias("t")),
        F.struct(F.col("predicted_label").alias("class_label"), zero.alias("s"), F.col("n").alias("p"), zero.alias("t")),
    )).alias("side")
    counts = confusion_counts(predictions, runs)
    margins = counts.select(*runs, sides).select(*runs, "side.*").groupBy(*runs, "class_label").agg(
        F.sum("s").alias("support"), F.sum("p").alias("positives"), F.sum("t").alias("hits")
    )
    grid = counts.select(*runs).distinct().withColumn("class_label", F.explode(_labels(classes)))
    table = grid.join(margins, [*runs, "class_label"], "left").na.fill(0, ["support", "positives", "hits"])
    precision, recall = F.col("precision"), F.col("recall")
    return (
        table.withColumn("precision", _ratio(F.col("hits"), F.col("positives")))
        .withColumn("recall", _ratio(F.col("hits"), F.col("support")))
        .withColumn("f1", _ratio(2 * precision * recall, precision + recall))
        .drop("positives")
    )


def overall_scores(scores: DataFrame, runs: list[str]) -> DataFrame:
    """Accuracy and plain class means over all declared classes."""
    return scores.groupBy(*runs).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"), F.avg("recall").alias("macro_recall"),
        F.sum("support").alias("evaluation_images"),
    )


def most_likely(probabilities: Column, classes: list[str]) -> Column:
    """The class of the largest probability, the first one on ties."""
    return F.element_at(_labels(classes), F.array_position(probabilities, F.array_max(probabilities)).cast("int"))


def prediction_violations(predictions: DataFrame, runs: list[str], classes: list[str]) -> DataFrame:
    """Per run: wrong widths, values that are not finite, unknown labels, wrong arg-max."""
    p = F.col("probabilities")
    finite = F.forall(p, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = F.col("true_label").isin(classes) & F.col("predicted_label").isin(classes)
    return predictions.groupBy(*runs).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.size(p) != len(classes)).alias("wrong_shape"),
        F.count_if(~finite).alias("nonfinite"),
        F.count_if(~known).alias("unknown_label"),
        F.count_if(most_likely(p, classes) != F.col("predicted_label")).alias("not_arg_max"),
    )


def mean_log_loss(predictions: DataFrame, runs: list[str], classes: list[str]) -> DataFrame:
    """Row-weighted mean of the negative log probability of the true class."""
    place = F.array_position(_labels(classes), F.col("true_label")).cast("int")
    loss = -F.log(F.element_at("probabilities", place))
    checked = F.when(loss.isNull() | F.isnan(loss) | (loss == float("inf")),
                     F.raise_error(F.lit("Loss is not finite")).cast("double")).otherwise(loss)
    return predictions.groupBy(*runs).agg(F.avg(checked).alias("mean_log_loss"), F.count(F.lit(1)).alias("rows"))


def class_weights(rows: DataFrame, mode: str = "sqrt") -> DataFrame:
    """Square-root balanced weights with row mean one, clipped to [0.5, 2]."""
    counts = rows.groupBy("class_label").agg(F.count(F.lit(1)).alias("n"))
    if mode == "none":
        return counts.withColumn("weight", F.lit(1.0))
    if mode != "sqrt":
        raise ValueError("mode is 'sqrt' or 'none'")
    # One row per class: the unnormalised weights are sqrt(N/(K*n)).
    totals = counts.groupBy().agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), F.sum(F.sqrt("n")).alias("roots"),
    ).withColumn("_one", F.lit(1))
    raw = F.sqrt(F.col("total") / (F.col("k") * F.col("n")))
    # mean over rows of raw = sum(raw*n)/N = sqrt(N/K) * sum(sqrt(n)) / N
    mean = F.sqrt(F.col("total") / F.col("k")) * F.col("roots") / F.col("total")
    return (
        counts.withColumn("_one", F.lit(1)).join(totals, "_one")
        .select("class_label", "n", F.least(F.lit(2.0), F.greatest(F.lit(0.5), raw / mean)).alias("weight"))
    )


def best_epoch(history: DataFrame, runs: list[str], loss: str = "development_loss", zero_based: bool = False) -> DataFrame:
    """First epoch with the least loss per run, counted from one."""
    shift = 1 if zero_based else 0
    return history.groupBy(*runs).agg(
        (F.min_by("epoch", F.struct(loss, "epoch")) + shift).alias("selected_epoch"),
        F.min(loss).alias("development_loss"),
        F.count(F.lit(1)).alias("epochs"),
    )


def epoch_violations(history: DataFrame, recorded: DataFrame, runs: list[str], tolerance: float = 2e-6, **options) -> DataFrame:
    """Runs whose recorded epoch or loss is not the best of their history."""
    found = best_epoch(history, runs, **options).select(
        *runs, F.col("selected_epoch").alias("best"), F.col("development_loss").alias("least")
    )
    a, b = F.col("development_loss"), F.col("least")
    near = F.abs(a - b) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs(a), F.abs(b)))
    return recorded.join(found, runs).where((F.col("selected_epoch") != F.col("best")) | ~near)


def recipe_summary(results: DataFrame) -> DataFrame:
    """Mean development loss and accuracy per recipe; every tuning run has equal weight."""
    bad = F.col("development_loss").isNull() | F.isnan("development_loss") | (
        F.abs("development_loss") == float("inf")
    )
    loss = F.when(bad, F.raise_error(F.lit("Tuning losses must be present and finite")).cast("double")).otherwise(
        F.col("development_loss")
    )
    return results.groupBy("recipe_name").agg(
        F.avg(loss).alias("mean_development_loss"),
        F.avg("development_accuracy").alias("mean_development_accuracy"),
        F.count(F.lit(1)).alias("runs"),
    )


def select_recipe(results: DataFrame, required: list[str] | None = None) -> DataFrame:
    """The recipe with the least mean development loss, then the least name."""
    summary = recipe_summary(results)
    if required:
        present = {r["recipe_name"] for r in summary.select("recipe_name").collect()}
        if set(required) - present:
            raise ValueError("Recipes without tuning results: " + ", ".join(sorted(set(required) - present)))
    best = F.struct("mean_development_loss", "recipe_name")
    return summary.groupBy().agg(
        F.min_by("recipe_name", best).alias("recipe_name"),
        F.min_by("mean_development_loss", best).alias("mean_development_loss"),
        F.min_by("mean_development_accuracy", best).alias("mean_development_accuracy"),
    )


def label_index(rows: DataFrame) -> DataFrame:
    """Distinct labels in order with zero-based indices."""
    from pyspark.sql import Window as W

    labels = rows.groupBy("class_label").agg(F.count(F.lit(1)).alias("n"))
    # The label list only: one row per class.
    return labels.withColumn(
        "label_index", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("class_label")).cast("long") - 1
    )


def close(a: Column, b: Column, tolerance: float = 2e-8) -> Column:
    """Equal within a relative or absolute tolerance."""
    bound = F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs(a), F.abs(b)))
    return F.coalesce(F.abs(a - b) <= bound, F.lit(False))


def score_violations(predictions: DataFrame, stored: DataFrame, stored_classes: DataFrame,
                     stored_confusion: DataFrame, runs: list[str], classes: list[str]) -> DataFrame:
    """Recompute all scores and list every stored value that differs.

    ``stored`` has run metrics, ``stored_classes`` class scores and
    ``stored_confusion`` long confusion counts.
    """
    scores = class_scores(predictions, runs, classes)
    overall = overall_scores(scores, runs)

    def compare(found: DataFrame, kept: DataFrame, keys: list[str], columns: list[str], check: str) -> DataFrame:
        a = found.select(*keys, F.lit(1).alias("_f"), *[F.col(c).cast("double").alias(f"f_{c}") for c in columns])
        b = kept.select(*keys, F.lit(1).alias("_k"), *[F.col(c).cast("double").alias(f"k_{c}") for c in columns])
        fields = F.explode(F.array(*[
            F.struct(F.lit(c).alias("field"), F.col(f"k_{c}").alias("stored"), F.col(f"f_{c}").alias("recomputed"))
            for c in columns
        ])).alias("v")
        subject = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
        return a.join(b, keys, "full").select(
            F.lit(check).alias("check"), subject.alias("subject"), fields
        ).select("check", "subject", "v.*").where(~close(F.col("stored"), F.col("recomputed")))

    return (
        compare(overall, stored, runs, [*METRICS, "evaluation_images"], "metrics")
        .unionByName(compare(scores, stored_classes, [*runs, "class_label"],
                             ["support", "precision", "recall", "f1"], "per_class"))
        .unionByName(compare(confusion_matrix(predictions, runs, classes), stored_confusion,
                             [*runs, "true_label", "predicted_label"], ["n"], "confusion_matrix"))
    )

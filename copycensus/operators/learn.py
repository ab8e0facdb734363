"""Fit on fitting rows, choose on development rows, score evaluation rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copycensus.session import materialize


def centroids(rows: DataFrame, by: list[str], dims: int) -> DataFrame:
    """Element-wise class means, as one array of (label, centre) per ``by``.

    The means are plain averages, combined before the shuffle; the array has
    one entry per class.
    """
    means = rows.groupBy(*by, "class_label").agg(
        *[F.avg(F.col("features")[i]).alias(f"m{i}") for i in range(dims)]
    )
    centre = F.struct(F.col("class_label").alias("label"), F.array(*[f"m{i}" for i in range(dims)]).alias("centre"))
    return means.groupBy(*by).agg(F.array_sort(F.collect_list(centre)).alias("centres"))


def nearest_centroid(conditions: DataFrame, dims: int, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Predict evaluation rows by the nearest fitting centroid of their condition.

    Only fitting rows reach the centroids. Distances are rounded so that ties
    go to the first label; probabilities are a softmax of negative distances.
    """
    by = by or ["condition"]
    fitted = materialize(centroids(conditions.where("partition = 'fitting'"), by, dims))

    def distance(centre: Column) -> Column:
        squares = F.zip_with("features", centre["centre"], lambda x, c: (x - c) * (x - c))
        return F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, s: acc + s)), digits)

    scored = conditions.where("partition = 'evaluation'").join(fitted, by).withColumn(
        "distances", F.transform("centres", distance)
    )
    weights = F.transform("distances", lambda d: F.exp(-d))
    return (
        scored.withColumn("_w", weights)
        .withColumn("_sum", F.aggregate("_w", F.lit(0.0), lambda acc, w: acc + w))
        .select(
            *by, "sample_id", F.col("class_label").alias("true_label"),
            F.get(
                F.col("centres")["label"],
                (F.array_position("distances", F.array_min("distances")) - 1).cast("int"),
            ).alias("predicted_label"),
            F.array_min("distances").alias("distance"),
            F.transform("_w", lambda w: w / F.col("_sum")).alias("probabilities"),
        )
    )


def regression_scores(rows: DataFrame, classes: list[str], penalties: tuple[float, ...] = (0.01, 0.1), seed: int = 1406) -> DataFrame:
    """Multinomial regression; the penalty is chosen by development log loss only.

    ``rows`` has one condition. Evaluation rows are scored once, by the chosen model.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    place = {c: float(i) for i, c in enumerate(classes)}
    index = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])[F.col("class_label")]
    table = materialize(rows.withColumn("target", index))
    ready = table.withColumn("vector", array_to_vector("features"))
    fitting = ready.where("partition = 'fitting'")
    development = ready.where("partition = 'development'")

    def loss(model) -> float:
        p = F.get(vector_to_array("probability"), F.col("target").cast("int"))
        return model.transform(development).agg(F.avg(-F.log(p))).first()[0]

    fits = [
        LogisticRegression(featuresCol="vector", labelCol="target", family="multinomial", regParam=r, maxIter=20).fit(fitting)
        for r in penalties
    ]
    losses = [loss(m) for m in fits]
    chosen = min(range(len(fits)), key=lambda i: (losses[i], penalties[i]))
    labels = F.array(*[F.lit(c) for c in classes])
    return fits[chosen].transform(ready.where("partition = 'evaluation'")).select(
        "sample_id", F.col("class_label").alias("true_label"),
        F.get(labels, F.col("prediction").cast("int")).alias("predicted_label"),
        F.slice(vector_to_array("probability"), 1, len(classes)).alias("probabilities"),
        F.lit(penalties[chosen]).alias("penalty"), F.lit(losses[chosen]).alias("development_loss"),
    )


def union_conditions(parts: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("condition", F.lit(n)) for n, df in parts.items()])


#: Features are whole millionths, so that sums over rows do not depend on their order.
UNIT = 1_000_000
SHRINKAGES = (0.0, 0.5)


@dataclass(frozen=True)
class BatchedRuns:
    """Many fits over one table: runs differ in the fitting rows that they use, studies in the features that they see.

    A row holds its vector once and a bit for each run. One pass sums the vectors of all runs and classes, one sums the
    development losses of all candidates, and one scores the evaluation rows; ids and bits are multiplied, vectors never.
    What comes to the driver is one number per run, class and feature, and one per run, study and candidate.
    """

    rows: DataFrame  # sample_id, class_label, partition, features, bits
    runs: list[tuple]  # keys of each bit
    classes: list[str]
    dims: int
    studies: dict[str, tuple[int, int]]  # first feature and the one behind the last
    shrinkages: tuple[float, ...] = SHRINKAGES

    def centres(self) -> np.ndarray:
        """Candidate x run x class x feature; not a number where a run has no row of a class."""
        n_classes, n_runs, dims = len(self.classes), len(self.runs), self.dims

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((n_classes, n_runs), np.int64)
            whole = np.zeros((n_classes, dims, n_runs), np.int64)
            for batch in batches:
                label, x, bits = batch.column(0).to_numpy(), _vectors(batch.column(1), dims), batch.column(2).to_numpy()
                used = (bits[:, None] >> np.arange(n_runs) & 1).astype(float)
                for c in np.unique(label):
                    mine = label == c
                    whole[c] += (x[mine].T.astype(float) @ used[mine]).astype(np.int64)  # exact below 2^53
                    n[c] += used[mine].sum(axis=0).astype(np.int64)
            c, d, r = (i.ravel() for i in np.indices(whole.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c), pa.array(d), pa.array(r), pa.array(whole.ravel()), pa.array(n[c, r])], names=["c", "d", "r", "total", "n"])

        table = self.rows.where("partition = 'fitting' AND bits <> 0").select("label", "features", "bits")
        sums, n = np.zeros((len(self.runs), len(self.classes), self.dims)), np.zeros((len(self.runs), len(self.classes)))
        for row in table.mapInArrow(fold, "c long, d long, r long, total long, n long").groupBy("c", "d", "r").agg(
                F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            sums[row["r"], row["c"], row["d"]], n[row["r"], row["c"]] = row["total"], row["n"]
        with np.errstate(invalid="ignore", divide="ignore"):
            own, all_ = sums / n[:, :, None], (sums.sum(axis=1) / n.sum(axis=1)[:, None])[:, None]
        return np.stack([((1 - s) * own + s * all_) / UNIT for s in self.shrinkages])

    def selection(self, centres: np.ndarray) -> dict[tuple[str, int], list[float]]:
        """Mean development loss of each candidate, by study and run."""
        studies, dims = self.studies, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[tuple, list] = {}
            for batch in batches:
                label, x = batch.column(0).to_numpy(), _vectors(batch.column(1), dims)
                for name, (a, b) in studies.items():
                    for k in range(len(centres)):
                        for r in range(centres.shape[1]):
                            d = distances(x[:, a:b] / UNIT, centres[k, r, :, a:b])
                            loss = d[np.arange(len(d)), label] + np.log(np.exp(-d).sum(axis=1))
                            loss = loss[np.isfinite(loss)]
                            held = out.setdefault((name, r, k), [0.0, 0])
                            held[0] += float(loss.sum())
                            held[1] += len(loss)
            rows = [(*key, *value) for key, value in out.items()]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names=["study", "r", "k", "loss", "n"])

        found = self.rows.where("partition = 'development'").select("label", "features").mapInArrow(
            run, "study string, r long, k long, loss double, n long").groupBy("study", "r", "k").agg(
            F.try_divide(F.sum("loss"), F.sum("n")).alias("loss")).collect()
        losses = {(name, r): [float("inf")] * len(self.shrinkages) for name in studies for r in range(len(self.runs))}
        for row in found:
            if row["loss"] is not None:
                losses[row["study"], row["r"]][row["k"]] = round(row["loss"], 6)
        return losses

    def selection_table(self, keys: list[str]) -> DataFrame:
        """``study, <keys>, shrinkage, development_loss, chosen`` of every candidate."""
        rows = []
        for (name, r), losses in self.selection(self.centres()).items():
            best = min(range(len(losses)), key=lambda k: (losses[k], self.shrinkages[k]))
            rows += [(name, *self.runs[r], s, loss, int(k == best)) for k, (s, loss) in enumerate(zip(self.shrinkages, losses, strict=True))]
        kinds = ", ".join(f"{k} {'long' if isinstance(x, int) else 'string'}" for k, x in zip(keys, self.runs[0], strict=True))
        return self.rows.sparkSession.createDataFrame(rows, f"study string, {kinds}, shrinkage double, development_loss double, chosen long")

    def predictions(self, keys: list[str]) -> DataFrame:
        """``study, <keys>, sample_id, true_label, predicted_label, shrinkage, distance`` of the evaluation rows.

        Each study and run uses the candidate of least development loss, the least shrinkage on ties.
        """
        centres = self.centres()
        losses = self.selection(centres)
        chosen = {key: min(range(len(v)), key=lambda k: (v[k], self.shrinkages[k])) for key, v in losses.items()}
        classes, studies, dims, shrinkages, runs = np.array(self.classes), self.studies, self.dims, self.shrinkages, self.runs
        columns = ["study", "r", "sample_id", "true_label", "predicted_label", "shrinkage", "distance"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                label, x, ids = batch.column(0).to_numpy(), _vectors(batch.column(1), dims), batch.column(2)
                for (name, r), k in chosen.items():
                    a, b = studies[name]
                    d = distances(x[:, a:b] / UNIT, centres[k, r, :, a:b])
                    best = np.argmin(d, axis=1)  # the first label on ties
                    n = len(d)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * n), pa.array(np.full(n, r)), ids, pa.array(classes[label]), pa.array(classes[best]),
                         pa.array(np.full(n, shrinkages[k])), pa.array(d[np.arange(n), best])], names=columns)

        scored = self.rows.where("partition = 'evaluation'").select("label", "features", "sample_id").mapInArrow(
            run, "study string, r long, sample_id string, true_label string, predicted_label string, shrinkage double, distance double")
        place = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in runs]), (F.col("r") + 1).cast("int"))
        return scored.select("study", *[place(i).alias(k) for i, k in enumerate(keys)], *columns[2:])


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def distances(x: np.ndarray, centres: np.ndarray, digits: int = 6) -> np.ndarray:
    """Rounded distances by one matrix product; infinite to a centre that is not there."""
    squares = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)
    return np.where(np.isnan(squares), np.inf, np.round(np.sqrt(np.maximum(squares, 0)), digits))


def batched_runs(
    rows: DataFrame, conditions: dict[str, Column], seeds: list[int], classes: list[str], dims: int, studies: dict[str, tuple[int, int]],
    kept_sixteenths: int = 14,
) -> BatchedRuns:
    """Runs for each condition and seed; a seed leaves out the fitting rows whose hash of seed and id is high.

    ``rows`` has ``sample_id, class_label, partition, features``; labels other than ``classes`` are an error.
    """
    runs = [(c, s) for c in conditions for s in seeds]
    if len(runs) > 62:
        raise ValueError("A row has room for the bits of 62 runs.")
    digit = {s: F.substring(F.sha2(F.concat(F.lit(f"{s}\0"), "sample_id"), 256), 1, 1) < f"{kept_sixteenths:x}" for s in seeds}
    bits = reduce(lambda a, b: a + b, [F.when(conditions[c] & digit[s], F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (c, s) in enumerate(runs)])
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class_label")) - 1
    label = F.when(place >= 0, place).otherwise(F.raise_error(F.concat(F.lit("Unknown label "), "class_label")).cast("long"))
    fixed = F.transform("features", lambda x: F.floor(x * UNIT))
    prepared = materialize(rows.select("sample_id", "partition", label.alias("label"), fixed.alias("features"), bits.alias("bits")))
    return BatchedRuns(prepared, runs, classes, dims, studies)

"""Manifest files, run trees, and the tables an audit leaves behind."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from copycensus.sources.folders import file_digests, path_exists, relative_path, unescaped


def read_manifest(spark: SparkSession, path: str, columns: list[str], multi_line: bool = False) -> DataFrame:
    """A CSV file with a header, every column a string; blanks stay blank strings.

    A file is split over tasks unless its values hold line ends (``multi_line``).
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(
        path, header=True, enforceSchema=False, escape='"', multiLine=multi_line, nullValue="\u0000", emptyValue=""
    )


#: Folders from the root of a run tree down to a run.
RUN_LEVELS = ("condition", "seed")


def _level(parts: Column, place: Column, level: str) -> Column:
    """The value that a folder stands for: its name, or the number of a ``seed_<n>``; no number gives a null seed."""
    name = F.get(parts, place)
    return F.regexp_extract(name, r"^seed_(\d+)$", 1).try_cast("long") if level == "seed" else name


def _run_columns(df: DataFrame, root: str, levels: tuple[str, ...]) -> DataFrame:
    """``path_<level>`` of each row's file, from the folders that it lies in."""
    below = F.split(relative_path(unescaped(F.col("_metadata.file_path")), root), "/")
    return df.select("*", *[
        _level(below, F.size(below) - (len(levels) + 1 - i), level).alias(f"path_{level}") for i, level in enumerate(levels)
    ])


def _run_files(root: str, levels: tuple[str, ...], name: str) -> str:
    return "/".join([root, *["seed_*" if level == "seed" else "*" for level in levels], name])


def read_runs(spark: SparkSession, root: str, levels: tuple[str, ...] = RUN_LEVELS) -> DataFrame:
    """All ``metrics.json`` of a run tree of any depth, such as ``study/condition/seed_<n>``.

    A field named like a level must agree with the folder; a level that no file has as a field comes from the folder.
    """
    runs = _run_columns(spark.read.json(_run_files(root, levels, "metrics.json"), multiLine=True), root, levels)
    wrong = F.lit(False)
    for level in levels:
        wrong |= F.col(f"path_{level}").isNull()
        if level in runs.columns:
            value = F.col(level).cast("long" if level == "seed" else "string")
            wrong |= ~value.eqNullSafe(F.col(f"path_{level}"))
        else:
            runs = runs.withColumn(level, F.col(f"path_{level}"))
    folder = F.concat_ws("/", *[
        F.concat(F.lit("seed_"), F.col("path_seed").cast("string")) if level == "seed" else F.col(f"path_{level}") for level in levels
    ])
    found = [r["folder"] for r in runs.where(wrong).select(folder.alias("folder")).take(3)]
    if found:
        raise ValueError(f"Fields of metrics.json disagree with the folder: {', '.join(found)}")
    if "artifacts_sha256" in runs.columns:
        as_map = F.from_json(F.to_json("artifacts_sha256"), T.MapType(T.StringType(), T.StringType()))
        runs = runs.withColumn("artifacts_sha256", as_map)
    return runs.drop(*[f"path_{level}" for level in levels])


def read_run_tables(spark: SparkSession, root: str, name: str, levels: tuple[str, ...] = RUN_LEVELS) -> DataFrame:
    """One CSV file per run as a single table keyed by the levels of the tree.

    Reading fails where a file's header names other columns, or the same in another order.
    """
    path = _run_files(root, levels, name)
    columns = spark.read.csv(path, header=True, inferSchema=False).schema
    table = _run_columns(spark.read.schema(columns).csv(path, header=True, enforceSchema=False), root, levels)
    for level in levels:
        table = table.withColumnRenamed(f"path_{level}", level)
    return table


def probabilities(predictions: DataFrame) -> tuple[DataFrame, list[str]]:
    """Fold ``prob_<class>`` columns into one array; their order is the class order."""
    columns = [c for c in predictions.columns if c.startswith("prob_")]
    folded = F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("probabilities")
    rest = [c for c in predictions.columns if c not in columns]
    return predictions.select(*rest, folded), [c.removeprefix("prob_") for c in columns]


def confusion_long(wide: DataFrame, classes: list[str], levels: tuple[str, ...] = RUN_LEVELS) -> DataFrame:
    """Long form of a stored confusion matrix."""
    keys = [*levels, "true_class"]
    return wide.select(*keys, *[F.col(f"`{c}`").cast("long").alias(c) for c in classes]).unpivot(
        keys, classes, "predicted_label", "n"
    ).withColumnRenamed("true_class", "true_label")


def run_artifacts(spark: SparkSession, root: str, levels: tuple[str, ...] = RUN_LEVELS) -> DataFrame:
    """Digest of every file below each run folder."""
    parts, depth = F.split("sample_id", "/"), len(levels)
    return file_digests(spark, root).where(F.size(parts) == depth + 1).select(
        *[_level(parts, F.lit(i), level).alias(level) for i, level in enumerate(levels)],
        F.get(parts, F.lit(depth)).alias("name"), F.col("file_sha256").alias("sha256"),
    )


# Sinks ------------------------------------------------------------------------

def write_table(df: DataFrame, path: str, columns: list[str] | None = None, fmt: str = "parquet") -> None:
    """Write a table in declared column order; an existing path is an error."""
    out = df.select(*columns) if columns else df
    if not out.columns:
        raise ValueError(f"No columns to write to {path}")
    writer = out.write.mode("errorifexists")
    writer.csv(path, header=True, escape='"') if fmt == "csv" else writer.format(fmt).save(path)


def freeze_table(df: DataFrame, path: str) -> None:
    """Write once; later calls must bring the same rows."""
    spark = df.sparkSession
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    if not path_exists(spark, path):
        text.write.mode("errorifexists").parquet(path)
        return
    stored = spark.read.parquet(path)
    if stored.columns != text.columns or stored.exceptAll(text).take(1) or text.exceptAll(stored).take(1):
        raise ValueError(f"Rows are not those frozen at {path}")


def freeze_settings(spark: SparkSession, path: str, settings: dict) -> None:
    """Write a small settings object once; later calls must bring an equal one."""
    value = json.dumps(json.loads(json.dumps(settings)), sort_keys=True)
    try:
        stored = spark.read.text(path).first()["value"]
    except AnalysisException:
        spark.range(1).select(F.lit(value).alias("value")).coalesce(1).write.text(path)
        return
    if json.loads(stored) != json.loads(value):
        raise ValueError(f"Settings are not those frozen at {path}; choose another folder")


def output_checksums(spark: SparkSession, root: str) -> DataFrame:
    """``line`` (``sha256  name``) and ``name`` of every data file of an output folder."""
    name = F.element_at(F.split("sample_id", "/"), -1)
    return file_digests(spark, root).where(~name.rlike(r"^[._]")).select(
        F.concat("file_sha256", F.lit("  "), "sample_id").alias("line"), F.col("sample_id").alias("name")
    )

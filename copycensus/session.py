"""Session construction, written intermediate tables and skew-safe group joins."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SHARED: dict[str, str] = {}


def build_session(app: str = "copycensus", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; keyword dots are written as ``__``."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a scratch folder only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach.")
    if context.applicationId not in _LOCAL_SHARED:
        _LOCAL_SHARED[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_SHARED[context.applicationId]


def materialize(df: DataFrame) -> DataFrame:
    """Write a table once and read it back.

    Cuts the lineage on storage that outlives an executor, and gives the
    planner the real size, so a join broadcasts it only if it is small.
    """
    spark = df.sparkSession
    # One folder per application, so that it can be removed when the application is done.
    path = f"{shared_dir(spark)}/copycensus-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, most_splits: int = 16) -> DataFrame:
    """Redistribute a tiny scan that has fewer splits than the session has cores.

    A scan of more than ``most_splits`` splits is left alone: shuffling its
    texts would cost more than the idle cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, most_splits) else df


def join_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equality join in which a null key equals a null key; the key columns are those of the left side."""
    renamed = right.select(
        *[F.col(f"`{k}`").alias(f"_right_{k}") for k in keys], *[F.col(f"`{c}`") for c in right.columns if c not in keys]
    )
    equal = reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, equal, how).drop(*[f"_right_{k}" for k in keys])


def join_groups(
    rows: DataFrame,
    groups: DataFrame,
    keys: list[str],
    size_col: str,
    id_col: str = "sample_id",
    how: str = "inner",
    rows_per_salt: int = 1_000_000,
) -> DataFrame:
    """Attach one-row-per-key ``groups`` to ``rows`` when some keys are huge; null keys meet null keys.

    ``groups`` should be materialized. A key with more than ``rows_per_salt``
    rows is hot: its rows are spread over salts of that many rows, and its
    group row is repeated once per salt. The plan is the same at every size;
    the list of hot keys has at most one entry per ``rows_per_salt`` rows, and
    the planner sends it, or ``groups``, to all tasks only if it is small in bytes.
    """
    salts = (F.floor(F.col(size_col) / rows_per_salt) + 1).cast("int")
    hot = groups.where(F.col(size_col) > rows_per_salt).select(*keys, salts.alias("_salts"))
    # A null id has a hash of its own, so it has a salt too.
    salted_rows = join_safe(rows, hot, keys, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(id_col), "_salts").cast("int"), F.lit(0))
    ).drop("_salts")
    repeats = F.when(F.col(size_col) > rows_per_salt, salts).otherwise(1)
    salted_groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), repeats - 1)))
    return join_safe(salted_rows, salted_groups, [*keys, "_salt"], how).drop("_salt")

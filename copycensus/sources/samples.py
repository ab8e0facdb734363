"""Adapters from plain tables to the canonical sample table.

Every adapter yields ``sample_id, class_label, original_split`` and identity
columns. Identities are taken from whole texts and whole rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copycensus.functions import signals
from copycensus.functions.identity import consensus, digest
from copycensus.session import spread

EVENT_METHODS = ("user_type_props", "user_type", "props")
LINE_METHODS = ("part_supplier", "part_quantity", "part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_split(sample_id: str = "sample_id") -> Column:
    """Provenance label for tables that have none: ten in sixteen ids are ``train``."""
    lead = F.substring(F.sha2(F.concat(F.lit("source\0"), F.col(sample_id)), 256), 1, 1)
    return F.when(lead < "a", "train").otherwise("val")


def canonical_text(text: str) -> Column:
    """Lower case with every run of blanks, tabs and line ends made one blank."""
    return F.lower(F.regexp_replace(text, "[ \\t\\r\\n]+", " "))


def letters_only(canonical: str) -> Column:
    """A coarser, lossy view of a canonical text: its ASCII letters."""
    return F.regexp_replace(canonical, "[^a-z]+", "")


def with_signatures(df: DataFrame, signatures: Column) -> DataFrame:
    """Add ahash, dhash, phash and hash_consensus."""
    return df.withColumn("_s", signatures).select("*", "_s.*").drop("_s").withColumn("hash_consensus", consensus())


def documents(spark: SparkSession, sf_dir: str, label: str = "lang") -> DataFrame:
    """Texts: three digests, coarser each time, and signatures of the symbol counts."""
    rows = (
        spread(table(spark, sf_dir, "documents"))
        .withColumn("sample_id", F.col("doc_id").cast("string"))
        .withColumn("canonical", canonical_text("text"))
    )
    return with_signatures(rows, signals.text_signatures("canonical")).select(
        "sample_id",
        F.col(label).alias("class_label"),
        source_split().alias("original_split"),
        digest("text").alias("file_sha256"),
        digest("canonical").alias("rgb_sha256"),
        digest(letters_only("canonical")).alias("input_sha256"),
        "ahash", "dhash", "phash", "hash_consensus",
        F.col("n_chars").cast("long").alias("n_chars"),
    )


def documents_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts beside their digests, for checks that compare the payloads themselves."""
    rows = spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("string").alias("sample_id"), "text", canonical_text("text").alias("canonical")
    )
    return rows.withColumns({"file_sha256": digest("text"), "rgb_sha256": digest("canonical")})


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 64 numbers read as 8x8 grids."""
    rows = (
        spread(table(spark, sf_dir, "embeddings"))
        .withColumn("sample_id", F.col("vec_id").cast("string"))
        .withColumn("signal", F.transform("embedding", lambda x: x.cast("double")))
    )
    return with_signatures(rows, signals.vector_signatures("signal")).select(
        "sample_id",
        F.col("label").cast("string").alias("class_label"),
        source_split().alias("original_split"),
        "ahash", "dhash", "phash", "hash_consensus",
        F.col("signal").alias("features"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: many copies per identity, from fine to coarse."""
    user = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").withColumn(
        "sample_id", F.col("event_id").cast("string")
    ).select(
        "sample_id",
        F.col("event_type").alias("class_label"),
        source_split().alias("original_split"),
        digest(F.concat_ws("|", user, "event_type", "props")).alias("user_type_props"),
        digest(F.concat_ws("|", user, "event_type")).alias("user_type"),
        digest("props").alias("props"),
    )


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines; the id is a digest of the whole row because no key is unique."""
    cents = [
        F.round(F.col(name) * 100).cast("long").cast("string")
        for name in ("l_extendedprice", "l_discount", "l_tax")
    ]
    quantity = F.col("l_quantity").cast("int").cast("string")
    row = F.concat_ws(
        "|",
        *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
        quantity, *cents, "l_returnflag", "l_linestatus",
        F.col("l_shipdate").cast("date").cast("string"),
    )
    part = F.col("l_partkey").cast("string")
    return spread(table(spark, sf_dir, "lineitem")).withColumn("sample_id", digest(row)).select(
        "sample_id",
        F.col("l_returnflag").alias("class_label"),
        source_split().alias("original_split"),
        F.concat_ws("|", part, F.col("l_suppkey").cast("string")).alias("part_supplier"),
        F.concat_ws("|", part, quantity).alias("part_quantity"),
        part.alias("part"),
    )

"""Labelled image folders as sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from copycensus.functions.identity import consensus
from copycensus.functions.images import image_identities
from copycensus.session import materialize

# File types each kind of scan accepts, in lower case.
AUDIT_TYPES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")
LOOSE_TYPES = ("png", "jpg", "jpeg", "bmp")

INVENTORY = T.StructType([
    T.StructField(n, T.StringType()) for n in ("sample_id", "original_split", "class_label")
])


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException:
        return False
    return True


def unescaped(uri: Column) -> Column:
    """A file URI with its percent escapes undone; a plus sign is no escape."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def relative_path(path: Column, root: str) -> Column:
    """Part of a plain file path below ``root``."""
    plain = F.regexp_replace(path, r"^[a-zA-Z0-9+.-]+:(//[^/]*)?", "")
    base = root.split("://", 1)[-1].rstrip("/") if "://" in root else root.removeprefix("file:").rstrip("/")
    if "://" in root:
        base = "/" + base.split("/", 1)[1] if "/" in base else ""
    return plain.substr(F.lit(len(base) + 2), F.length(plain))


def _files(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("sample_id", "/")
    name = F.element_at(parts, -1)
    return scan.select(relative_path(F.col("path"), root).alias("sample_id"), *columns).withColumns({
        "_depth": F.size(parts), "_parts": parts,
        "_type": F.when(F.instr(name, ".") > 1, F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))).otherwise(""),
    })


def _guarded(rows: DataFrame, root: str) -> DataFrame:
    """Fail on an empty inventory or repeated ids."""
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("k")).first()
    if not seen["n"]:
        raise ValueError(f"No image files below {root}")
    if seen["n"] != seen["k"]:
        raise ValueError("Two files share a sample id")
    return rows


def class_folders(spark: SparkSession, root: str) -> DataFrame:
    """Files at exactly ``class/file``; one pooled split."""
    files = _files(spark, root, [])
    rows = files.where((F.col("_depth") == 2) & F.col("_type").isin(*AUDIT_TYPES)).select(
        "sample_id", F.lit("pooled").alias("original_split"), F.col("_parts")[0].alias("class_label")
    )
    return _guarded(rows, root)


def split_folders(spark: SparkSession, root: str, train: str = "train", evaluation: str = "test") -> DataFrame:
    """Files at ``split/class/file`` under the two given splits, both of which must exist."""
    for split in (train, evaluation):
        if not path_exists(spark, f"{root}/{split}"):
            raise ValueError(f"Split folder not found: {root}/{split}")
    files = _files(spark, root, [])
    rows = files.where(
        (F.col("_depth") == 3) & F.col("_type").isin(*AUDIT_TYPES) & F.col("_parts")[0].isin(train, evaluation)
    ).select("sample_id", F.col("_parts")[0].alias("original_split"), F.col("_parts")[1].alias("class_label"))
    return _guarded(rows, root)


def strict_layout(spark: SparkSession, root: str) -> DataFrame:
    """PNG files, every one of them at ``train|val/class/file``."""
    files = _files(spark, root, []).where("_type = 'png'")
    bad = files.where((F.col("_depth") != 3) | ~F.col("_parts")[0].isin("train", "val"))
    found = [r["sample_id"] for r in bad.select("sample_id").take(3)]
    if found:
        raise ValueError(f"Paths other than train|val/class/file.png: {', '.join(found)}")
    return _guarded(files.select(
        "sample_id", F.col("_parts")[0].alias("original_split"), F.col("_parts")[1].alias("class_label")
    ), root)


def loose_folders(spark: SparkSession, root: str) -> DataFrame:
    """Image files at any depth, labelled by their folder; an absent root gives no rows."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], INVENTORY)
    files = _files(spark, root, []).where(F.col("_type").isin(*LOOSE_TYPES))
    base = root.rstrip("/").rsplit("/", 1)[-1]
    label = F.when(F.col("_depth") > 1, F.get("_parts", F.col("_depth") - 2)).otherwise(F.lit(base))
    return files.select("sample_id", F.lit("pooled").alias("original_split"), label.alias("class_label"))


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """Byte digest and size of every file below ``root``."""
    return _files(spark, root, ["content", "length"]).select(
        "sample_id", F.sha2("content", 256).alias("file_sha256"), F.col("length").alias("file_size_bytes")
    )


def decoded(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images by sample id, from Spark's image source.

    The source shows size, channels and pixels. It exposes neither the frame
    count nor the orientation tag, so those two cannot be checked here.
    """
    scan = spark.read.format("image").option("recursiveFileLookup", "true").load(root)
    return scan.select(relative_path(unescaped(F.col("image.origin")), root).alias("sample_id"), "image")


def decode_violations(inventory: DataFrame, images: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """Listed samples that were not decoded, or are not colour images of the given size."""
    joined = inventory.select("sample_id").join(
        images.select("sample_id", "image.height", "image.width", "image.nChannels", "image.mode"), "sample_id", "left"
    )
    problem = F.when(F.col("mode").isNull() | (F.col("mode") < 0), "not decoded")
    if size:
        problem = problem.when(
            (F.col("nChannels") != 3) | (F.col("height") != size[0]) | (F.col("width") != size[1]), "wrong size or mode"
        )
    return joined.withColumn("problem", problem).where("problem is not null").select("sample_id", "problem")


def hash_samples(spark: SparkSession, root: str, inventory: DataFrame) -> DataFrame:
    """Inventory with digests, sizes and signatures. Pixels never leave the scan's tasks."""
    mode = F.when(F.col("image.nChannels") == 1, "L").when(F.col("image.nChannels") == 3, "RGB").otherwise("RGBA")
    hashed = decoded(spark, root).where("image.mode >= 0").withColumns(image_identities()).select(
        "sample_id", mode.alias("source_mode"), F.col("image.width").alias("width"),
        F.col("image.height").alias("height"), "rgb_sha256", "input_sha256", "_signatures.*",
    ).withColumn("hash_consensus", consensus())
    rows = materialize(inventory.join(file_digests(spark, root), "sample_id").join(hashed, "sample_id", "left"))
    missing = [r["sample_id"] for r in rows.where("rgb_sha256 is null").select("sample_id").take(3)]
    if missing:
        raise ValueError(f"Images that could not be decoded: {', '.join(missing)}")
    return rows

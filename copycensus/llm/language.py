"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte n-grams (1 to 3 bytes; ASCII letters lowered, runs of other ASCII one blank), weighted by log counts and inverse
document frequency and normalised. Document frequencies cover all training rows. Each language's centroids come from
spherical k-means on a sample of about ``per_language`` of its training rows; that bound is the only sampling. A prediction
is the language of the nearest centroid by cosine; ``rejected`` marks texts farther from it than its own members were.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows without text or language are not learned
from; without any training row everything is ``und``; repeated rows count one by one; other columns are ignored; an empty
table gives an empty table. The language, source and id never enter a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copycensus.llm.hashing import slices, utf8
from copycensus.session import materialize

FEATURES = 4096
PER_LANGUAGE = 500
CENTROIDS = 4
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[b for b in range(128) if not chr(b).isalpha()]] = 32
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def counts(column: pa.Array, features: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts (text x feature) and whether each text has a letter."""
    data, bounds = utf8(column)
    code = _LOWER[data]
    out = np.zeros((len(column), features), np.float32)
    letters = np.zeros(len(column), bool)
    for i in range(len(column)):
        x = code[bounds[i]:bounds[i + 1]]
        if len(x):
            x = x[np.append(True, (x[1:] != 32) | (x[:-1] != 32))]
        if not len(x):
            continue
        letters[i] = _ASCII_LETTER[data[bounds[i]:bounds[i + 1]]].any() or bool(
            x.max() > 127 and _LETTER.search(data[bounds[i]:bounds[i + 1]].tobytes().decode()))
        grams = [x + np.uint32(7)]
        if len(x) > 1:
            grams.append(x[:-1] * np.uint32(257) + x[1:] + np.uint32(1000))
        if len(x) > 2:
            grams.append((x[:-2] * np.uint32(257) + x[1:-1]) * np.uint32(257) + x[2:] + np.uint32(90000))
        slot = (np.concatenate(grams) * np.uint32(2654435761)) >> np.uint32(32 - int(np.log2(features)))
        out[i] = np.bincount(slot, minlength=features)
    return out, letters


def vectors(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised TF-IDF vectors and the letter flags."""
    x, letters = counts(column, len(idf))
    np.log1p(x, out=x)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return x, letters


@dataclass(frozen=True)
class Model:
    """Sizes are set by the number of languages, not by the number of rows."""

    languages: tuple[str, ...]  # of each centroid
    centroids: np.ndarray
    least: np.ndarray  # cosine under which a text is rejected, by centroid
    idf: np.ndarray


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids by cosine and each row's centroid; starts from rows far from one another."""
    chosen = [0]
    near = x @ x[0]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    centers = x[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centers.T, axis=1)
        for c in range(len(centers)):
            if (own == c).any():
                centers[c] = x[own == c].mean(axis=0)
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-9)
    return centers, np.argmax(x @ centers.T, axis=1)


def fit(
    docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE,
    k: int = CENTROIDS, features: int = FEATURES,
) -> Model:
    rows = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"), F.col(label).cast("string").alias("_label"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(features, np.int64), 0
        for batch in batches:
            for part in slices(batch, "_text"):
                total += (counts(part.column(0), features)[0] > 0).sum(axis=0)
                n += part.num_rows
        if n:
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(found, -1)), pa.array(np.append(total[found], n))], names=["feature", "n"])

    seen = {r["feature"]: r["n"] for r in rows.select("_text").mapInArrow(frequencies, "feature long, n long")
            .groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    n = seen.pop(-1, 0)
    idf = np.log((1 + n) / (1 + np.zeros(features)))
    for feature, documents in seen.items():
        idf[feature] = np.log((1 + n) / (1 + documents)) + 0.05
    idf = idf.astype(np.float32)

    # Written, so that the planner knows how small it is and does not shuffle the texts by language.
    sizes = materialize(rows.groupBy("_label").agg(F.count(F.lit(1)).alias("_n")))
    rank = F.pmod(F.xxhash64("_key", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(sizes, "_label").where(rank * F.col("_n") < per_language).select("_label", "_text")

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_text")
        x, letters = vectors(pa.array(group["_text"], pa.string()), idf)
        x = x[letters]
        if not len(x):
            return pd.DataFrame({"label": [], "center": [], "least": []})
        centers, own = clustered(x, k)
        cosine = (x * centers[own]).sum(axis=1)
        least = [float(np.mean(cosine[own == c]) - 3 * np.std(cosine[own == c])) if (own == c).any() else 1.0 for c in range(len(centers))]
        return pd.DataFrame({"label": group["_label"].iloc[0], "center": [c.astype("<f4").tobytes() for c in centers], "least": least})

    found = sample.groupBy("_label").applyInPandas(centroids, "label string, center binary, least double").orderBy("label", "center").collect()
    centers = np.stack([np.frombuffer(r["center"], "<f4") for r in found]) if found else np.zeros((0, features), np.float32)
    return Model(tuple(r["label"] for r in found), centers, np.array([r["least"] for r in found]), idf)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred, score, rejected``; columns of these names are replaced."""
    added = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}
    kept = docs.select(*[c for c in docs.columns if c not in added])
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, t) for n, t in added.items()]])
    at = kept.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, text):
                x, letters = vectors(part.column(at), own.idf)
                if len(own.languages):
                    cosine = x @ own.centroids.T
                    best = np.argmax(cosine, axis=1)
                    score = np.where(letters, np.clip(cosine[np.arange(len(x)), best], 0, 1), 0.0).astype(float)
                    label = [own.languages[b] if known else UNKNOWN for b, known in zip(best, letters, strict=True)]
                    rejected = ~letters | (score < own.least[best])
                else:
                    score, label, rejected = np.zeros(len(x)), [UNKNOWN] * len(x), np.ones(len(x), bool)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(label, pa.string()), pa.array(score), pa.array(rejected)], names=schema.names)

    return kept.mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))

"""Identity columns of decoded images, computed in Arrow batches.

Spark's ``image`` source decodes the files and spreads them over the tasks; the
functions here only rearrange or resample one decoded array at a time with
constant matrices.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copycensus.functions.signals import SIGNATURE_TYPE, cosine_rows, hex_bits

# Workers receive these functions by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Integer luma weights of the 8-bit grey conversion, over 65536.
LUMA = (19595, 38470, 7471)


def lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def bicubic(x: np.ndarray) -> np.ndarray:
    a, x = -0.5, np.abs(x)
    near = ((a + 2) * x - (a + 3)) * x * x + 1
    far = (((x - 5) * x + 8) * x - 4) * a
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


FILTERS = {"lanczos": (lanczos, 3.0), "bicubic": (bicubic, 2.0)}


@lru_cache(maxsize=256)
def resample_matrix(outputs: int, inputs: int, kind: str) -> np.ndarray:
    """Weights that resample a line of ``inputs`` cells to ``outputs`` cells.

    When shrinking, the kernel is stretched over the source cells it covers.
    """
    kernel, support = FILTERS[kind]
    scale = inputs / outputs
    stretch = max(scale, 1.0)
    centres = (np.arange(outputs) + 0.5) * scale
    cells = np.arange(inputs)
    first = np.maximum(np.floor(centres - support * stretch + 0.5), 0)[:, None]
    last = np.minimum(np.floor(centres + support * stretch + 0.5), inputs)[:, None]
    weights = kernel((cells[None, :] + 0.5 - centres[:, None]) / stretch)
    weights = np.where((cells >= first) & (cells < last), weights, 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def to_byte(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values + 0.5), 0, 255)


def resample(plane: np.ndarray, height: int, width: int, kind: str) -> np.ndarray:
    """Across first, then down, with 8-bit rounding after each pass."""
    across = to_byte(plane @ resample_matrix(width, plane.shape[1], kind).T)
    return to_byte(resample_matrix(height, plane.shape[0], kind) @ across)


def rgb_array(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """The source's BGR(A) or grey bytes as an RGB array."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]


def grey(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[:, :, i].astype(np.int64) for i in range(3))
    return ((r * LUMA[0] + g * LUMA[1] + b * LUMA[2] + 0x8000) >> 16).astype(np.float64)


def image_signatures(rgb: np.ndarray) -> tuple[str, str, str]:
    plane = grey(rgb)
    small = resample(plane, 8, 8, "lanczos")
    steps = resample(plane, 8, 9, "lanczos")
    waves = np.array(cosine_rows(8, 32))
    block = waves @ resample(plane, 32, 32, "lanczos") @ waves.T
    return (
        *hex_bits((small > small.mean()).reshape(1, -1)),
        *hex_bits((steps[:, 1:] > steps[:, :-1]).reshape(1, -1)),
        *hex_bits((block > np.median(block)).reshape(1, -1)),
    )


@F.pandas_udf(T.BinaryType())
def rgb_bytes(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([rgb_array(*row).tobytes() for row in zip(height, width, channels, data)])


@F.pandas_udf(SIGNATURE_TYPE)
def signatures(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
    rows = [image_signatures(rgb_array(*row)) for row in zip(height, width, channels, data)]
    return pd.DataFrame(rows, columns=["ahash", "dhash", "phash"])


@F.pandas_udf(T.BinaryType())
def model_input(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    """224x224 bicubic float32 pixels in [0, 1], little endian."""
    out = []
    for row in zip(height, width, channels, data):
        rgb = rgb_array(*row).astype(np.float64)
        planes = [resample(rgb[:, :, i], 224, 224, "bicubic") for i in range(3)]
        out.append((np.stack(planes, axis=2).astype("<f4") / np.float32(255.0)).astype("<f4").tobytes())
    return pd.Series(out)


def payload_digest(dtype: str, height: Column, width: Column, data: Column) -> Column:
    """Digest of a JSON header with type and shape, a line end, and the raw array."""
    header = F.concat(
        F.lit('{"dtype":"' + dtype + '","shape":['), height.cast("string"), F.lit(","),
        width.cast("string"), F.lit(",3]}\n"),
    )
    return F.sha2(F.concat(F.encode(header, "UTF-8"), data), 256)


def image_identities(image: str = "image") -> dict[str, Column]:
    """``rgb_sha256``, ``input_sha256`` and the three signatures of an image struct."""
    parts = [F.col(f"{image}.{f}") for f in ("height", "width", "nChannels", "data")]
    return {
        "rgb_sha256": payload_digest("|u1", parts[0], parts[1], rgb_bytes(*parts)),
        "input_sha256": payload_digest("<f4", F.lit(224), F.lit(224), model_input(*parts)),
        "_signatures": signatures(*parts),
    }

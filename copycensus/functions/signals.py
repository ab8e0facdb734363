"""64-bit signatures of 8x8 grids, computed in Arrow batches.

A batch of grids is one array, so the transform is a product with a constant
matrix. The same job in column expressions takes 64 passes over each text and
some two thousand interpreted steps per row.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Workers receive these functions by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIDE = 8

#: Values turned into grids at once.
SLICE_ROWS = 256

# The characters whose counts make up the grid of a text.
TEXT_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789áéíóúñüäößèêçàâôî .,;:!?'\"-@"

SIGNATURE_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("ahash", "dhash", "phash")])


def cosine_rows(outputs: int, samples: int) -> list[list[float]]:
    """Unnormalised type-II cosine transform as a matrix."""
    return [
        [2.0 * math.cos(math.pi * k * (2 * n + 1) / (2 * samples)) for n in range(samples)]
        for k in range(outputs)
    ]


def hex_bits(bits: np.ndarray) -> list[str]:
    """Rows of 64 booleans to 16 hex digits each, most significant bit first."""
    if bits.shape[-1] != SIDE * SIDE:
        raise ValueError("A signature must have 64 bits")
    return [row.tobytes().hex() for row in np.packbits(bits, axis=-1)]


def grid_signatures(grids: np.ndarray) -> dict[str, list[str]]:
    """ahash, dhash and phash of n grids, given as n rows of 64 cells.

    dhash resamples rows of 8 to 9 cells by area: cell j is
    ``j*x[j-1] + (8-j)*x[j]``. Cosine coefficients are rounded so that equal
    ones tie whatever the order of summation.
    """
    n = len(grids)
    x = grids.reshape(n, SIDE, SIDE)
    j = np.arange(SIDE)
    before, after = x[:, :, np.maximum(j - 1, 0)], x[:, :, np.minimum(j + 1, SIDE - 1)]
    rises = (j + 1) * x + (SIDE - 1 - j) * after > j * before + (SIDE - j) * x
    matrix = np.array(cosine_rows(SIDE, SIDE))
    waves = np.round(matrix @ (x @ matrix.T), 6).reshape(n, -1)
    return {
        "ahash": hex_bits(grids > grids.mean(axis=1, keepdims=True)),
        "dhash": hex_bits(rises.reshape(n, -1)),
        "phash": hex_bits(waves > np.median(waves, axis=1, keepdims=True)),
    }


def symbol_counts(text: str) -> np.ndarray:
    """How often each fixed symbol occurs in the whole text."""
    codes = np.frombuffer(text.encode("latin-1", "ignore"), dtype=np.uint8)
    return np.bincount(codes, minlength=256)


def _in_slices(column: pa.Array, cells: Callable[[pa.Array], np.ndarray], rows: int = SLICE_ROWS) -> pa.Array:
    """Signatures of the cells of ``rows`` values at a time, null for null.

    A batch is as large as the session makes it; beside it a worker holds the values and grids of one slice only.
    """
    names = [f.name for f in SIGNATURE_TYPE]
    parts = []
    for at in range(0, max(len(column), 1), rows):
        part = column.slice(at, rows)
        signatures = grid_signatures(cells(part).reshape(len(part), SIDE * SIDE))
        known = part.is_valid().to_numpy(zero_copy_only=False)
        parts.append(pa.StructArray.from_arrays([pa.array(signatures[n], pa.string(), mask=~known) for n in names], names))
    return pa.concat_arrays(parts)


def _text_cells(texts: pa.Array) -> np.ndarray:
    symbols = np.frombuffer(TEXT_SYMBOLS.encode("latin-1"), dtype=np.uint8)
    out = np.zeros((len(texts), len(symbols)))
    for i, text in enumerate(texts):
        out[i] = symbol_counts(text.as_py() or "")[symbols]
    return out


def _vector_cells(vectors: pa.Array) -> np.ndarray:
    return np.array([np.zeros(SIDE * SIDE) if v is None else np.asarray(v, dtype=np.float64) for v in vectors.to_pylist()])


@F.arrow_udf(SIGNATURE_TYPE)
def text_signatures(text: pa.Array) -> pa.Array:
    """Signatures of the symbol counts of whole texts; null for null."""
    return _in_slices(text, _text_cells)


@F.arrow_udf(SIGNATURE_TYPE)
def vector_signatures(vector: pa.Array) -> pa.Array:
    """Signatures of 64-element vectors read as grids; null for null."""
    return _in_slices(vector, _vector_cells)

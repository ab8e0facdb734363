"""Words and word shingles of a batch of texts as 64-bit hashes, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_BYTE = _BYTE[_LOWER]


def _powers_of(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 1 << 20)
        _powers, _inverses = _powers_of(_BASE, n), _powers_of(pow(_BASE, -1, 1 << 64), n)
    return _powers, _inverses


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the bounds of each; null is empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = pa.concat_arrays([column.fill_null("")])
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and last byte + 1 of every word, and each text's bounds within these words.

    A word's hash is a polynomial of its bytes; texts of any length are taken whole. Only A-Z are lowered.
    """
    data, bounds = utf8(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(bounds), np.int64)
    space = _IS_SPACE[data]
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = True  # a text begins
    starts = np.flatnonzero(before & ~space)
    after = np.ones(len(data), bool)
    after[:-1] = before[1:]
    after[:-1] |= space[1:]
    ends = np.flatnonzero(after & ~space) + 1
    powers, inverses = _grown(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER_BYTE if lower else _BYTE)[data] * powers[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverses[starts])
    return hashes, starts, ends, np.searchsorted(starts, bounds)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total = total * np.uint64(0xD1342543DE82EF95) + hashes[j:j + n]
    return mix(total)


class ByteRuns:
    """Hashes of byte runs of any width, from one pass over the bytes."""

    def __init__(self, data: np.ndarray):
        powers, self.inverses = _grown(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers[: len(data)], out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        return mix((self.sums[width:] - self.sums[:-width]) * self.inverses[: len(self.sums) - width])

    def at(self, starts: np.ndarray, width: int) -> np.ndarray:
        return mix((self.sums[starts + width] - self.sums[starts]) * self.inverses[starts])


def byte_hashes(data: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """Hash of the runs of ``width`` bytes that begin at ``at``."""
    return ByteRuns(data).at(at, width)


def sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over every run of ``width``, by prefixes and suffixes of blocks."""
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.concatenate([x, np.full(-n % width, x[-1], x.dtype)]).reshape(-1, width)
    ahead = op.accumulate(padded, axis=1).ravel()
    behind = op.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - width + 1], ahead[width - 1: n])


def least_places(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the least hash of some window of ``window`` places; ties all count."""
    if len(hashes) < window:
        return np.flatnonzero(hashes == hashes.min()) if len(hashes) else np.zeros(0, np.int64)
    edge = np.zeros(window - 1, np.uint64)
    least = sliding(hashes, window, np.minimum)
    return np.flatnonzero(sliding(np.concatenate([edge, least, edge]), window, np.maximum) == hashes)


def first_least(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that hold the first least hash of some window, and the first and the last start of those windows."""
    least = sliding(hashes, window, np.minimum)
    at = least_places(hashes, window)
    values = np.unique(hashes[at])
    n = np.int64(len(hashes))
    keyed = np.sort(np.searchsorted(values, hashes[at]) * n + at)
    # The first place from the window's start on that holds the window's least hash.
    own = keyed[np.searchsorted(keyed, np.searchsorted(values, least) * n + np.arange(len(least)))] % n
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[new], new, np.append(new[1:], len(own)) - 1


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each (one text at least), so that memory follows one part."""
    _, bounds = utf8(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to

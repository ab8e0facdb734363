"""Periodic runs of words by block convolution at dyadic scales.

A run is a maximal stretch with smallest period q and a length of ``max(LEAST, TIMES * q)`` words or more. At scale B, a
power of two, the word numbers are cut into blocks of B. A run with (2B - 1) / 3 <= q < (4B - 1) / 3 has 3q >= 2B - 1 words
beside one period, so it holds a whole block together with the block's copy q words later, and each q belongs to one scale.
Where the copies of a block are follows from the sum of squared differences of the block and its following window,

    sum (a[i] - b[i + q])^2 = sum a^2 - 2 sum a[i] b[i + q] + sum b^2,

with the middle term from a number-theoretic transform of length 2B over the integers modulo 65537. The arithmetic is exact:
an occurrence without a mismatch always gives zero, and a sum that is zero only modulo the prime is told apart by its words.
Blocks that follow each other at one distance are one seed, seeds are extended word by word on both sides, by less than a
block each, and a stretch whose period is a multiple of a smaller one is dropped.

Documents of an Arrow batch are laid end to end and share the transforms; no seed or extension crosses a document. Scales beyond the
longest transform use several windows per block. Memory is bounded by a batch of about 1 MB of text or one document.

Defined cases: a null text, an empty one and one without words have no run; very long texts are taken whole; repeated rows
each return a row; a row without an id stays; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copycensus.llm.hashing import slices, word_hashes

LEAST = 6
TIMES = 4
PRIME = 65537
#: A generator of the units modulo PRIME; their number is a power of two.
GENERATOR = 3
#: Longest transform, transforms that are one matrix product, and numbers transformed at once.
LONGEST = 65536
DIRECT = 64
AT_ONCE = 1 << 20


def _residues(x: np.ndarray) -> np.ndarray:
    """Integers below 2^46 (as floats) modulo PRIME, within -2^14 and 2^16: 2^16 is -1."""
    x = x.astype(np.int64)
    x = (x & 0xFFFF) - (x >> 16)
    x = (x & 0xFFFF) - (x >> 16)
    return x.astype(np.float64)


@cache
def _powers(n: int, inverse: bool, rows: int, columns: int) -> np.ndarray:
    """w^(i j) for a primitive n-th root w, centred on zero so that products stay small."""
    w = pow(GENERATOR, (PRIME - 1) // n * (n - 1 if inverse else 1), PRIME)
    table = np.ones(n, np.int64)
    for i in range(1, n):
        table[i] = table[i - 1] * w % PRIME
    out = table[np.outer(np.arange(rows), np.arange(columns)) % n]
    return np.where(out > PRIME // 2, out - PRIME, out).astype(np.float64)


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row (its length is a power of two), without the division by the length.

    Short transforms are one matrix product: all partial sums are integers below 2^53, so doubles hold them exactly. Longer
    ones are split in two factors with twiddles in between.
    """
    n = x.shape[-1]
    if n <= DIRECT:
        return _residues(x @ _powers(n, inverse, n, n))
    a, b = DIRECT, n // DIRECT
    inner = transform(np.ascontiguousarray(x.reshape(-1, a, b).transpose(0, 2, 1)).reshape(-1, a), inverse).reshape(-1, b, a)
    inner = _residues(inner * _powers(n, inverse, b, a))
    outer = transform(np.ascontiguousarray(inner.transpose(0, 2, 1)).reshape(-1, b), inverse).reshape(-1, a, b)
    return outer.transpose(0, 2, 1).reshape(-1, n)


def occurrences(values: np.ndarray, starts: np.ndarray, size: int, low: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Block starts and distances (``low`` to ``low + many - 1``) where the squared differences of a block sum to zero.

    ``values`` are within 0 and PRIME - 1 and reach beyond the last window; size + many - 1 <= 2 * size.
    """
    n = 2 * size
    rows_at_once = max(1, AT_ONCE // n)
    squares = np.concatenate([[0], np.cumsum(values.astype(np.int64) ** 2 % PRIME)])
    centred = np.where(values > PRIME // 2, values - PRIME, values).astype(np.float64)
    found, distances = [], []
    scale = float(pow(n, -1, PRIME))
    for at in range(0, len(starts), rows_at_once):
        begin = starts[at:at + rows_at_once]
        block = np.zeros((len(begin), n))
        block[:, :size] = centred[begin[:, None] + np.arange(size)]
        window = np.zeros((len(begin), n))
        window[:, :size + many - 1] = centred[begin[:, None] + low + np.arange(size + many - 1)]
        # Correlation: the block's transform with the inverse root is that of the reversed block.
        product = _residues(transform(block, True) * transform(window))
        cross = _residues(_residues(transform(product, True)[:, :many]) * scale).astype(np.int64)
        shift = begin[:, None] + low + np.arange(many)
        own = squares[begin + size] - squares[begin]
        total = own[:, None] - 2 * cross + squares[shift + size] - squares[shift]
        row, column = np.nonzero(total % PRIME == 0)
        found.append(begin[row])
        distances.append(column + low)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found]), np.concatenate([none, *distances])


def _reach(ids: np.ndarray, owner: np.ndarray, at: np.ndarray, q: np.ndarray, size: int, step: int) -> np.ndarray:
    """How many words from ``at`` on, in the given direction, equal the word q later in the same document; at most ``size``."""
    out = np.zeros(len(at), np.int64)
    rows = max(1, AT_ONCE // size)
    for low in range(0, len(at), rows):
        place = at[low:low + rows, None] + step * np.arange(size)
        inside = (place >= 0) & (place + q[low:low + rows, None] < len(ids))
        here = np.where(inside, place, 0)
        there = np.where(inside, place + q[low:low + rows, None], 0)
        equal = inside & (ids[here] == ids[there]) & (owner[here] == owner[there])
        out[low:low + rows] = np.where(equal.all(axis=1), size, np.argmin(equal, axis=1))
    return out


def _smallest(ids: np.ndarray, start: int, q: int) -> bool:
    """Whether no divisor of q is a period of a stretch of 2q words or more with period q."""
    for r in range(2, q + 1):
        if q % r == 0:
            p = q // r
            if (ids[start:start + q] == ids[start + p:start + p + q]).all():
                return False
    return True


def runs(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows ``document, start, length, period`` of all runs, in this order, from the word numbers of documents end to end."""
    n, sizes = len(ids), np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    most = int(sizes.max(initial=0)) // TIMES
    out: list[np.ndarray] = []
    values = ids % PRIME
    covered = np.zeros((2, n), np.int64)  # by place: the furthest end of a run found so far that holds it, and its period
    size = 2
    while (2 * size + 1) // 3 <= most:  # the least distance of this scale
        block = min(size, LONGEST // 2)
        first, last = (2 * size + 1) // 3, min((4 * size - 2) // 3, most)
        starts = np.arange(0, n - block + 1, block)
        long = sizes[owner[starts]] >= TIMES * first
        starts = starts[long & (owner[starts] == owner[starts + block - 1])]
        k, q = [], []
        for low in range(first, last + 1, block):
            many = min(block, last + 1 - low)
            padded = np.concatenate([values, np.zeros(low + block + many, values.dtype)])
            a, b = occurrences(padded, starts, block, low, many)
            k.append(a)
            q.append(b)
        k, q = np.concatenate(k), np.concatenate(q)
        inside = k + q + block <= n
        inside[inside] = owner[k[inside]] == owner[k[inside] + q[inside] + block - 1]
        # A multiple of the period of a known run around block and copy is no smallest period.
        inside[inside] &= (covered[0, k[inside]] < k[inside] + q[inside] + block) | (q[inside] % np.maximum(covered[1, k[inside]], 1) > 0)
        k, q = k[inside], q[inside]
        # A sum may be zero by the modulus alone: the words themselves decide.
        same = _reach(ids, owner, k, q, block, 1) == block
        k, q = k[same], q[same]
        if len(k):
            order = np.lexsort((k, q))
            k, q = k[order], q[order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(q) > 0) | (np.diff(k) != block)]))
            to, k, q = k[np.append(new[1:], len(k)) - 1], k[new], q[new]
            # Extensions end within the next block, which did not match or is another document's.
            begin = k - _reach(ids, owner, k - 1, q, block, -1)
            end = to + block + _reach(ids, owner, to + block, q, block, 1) + q
            good = end - begin >= np.maximum(LEAST, TIMES * q)
            rows = [(b, e, p) for b, e, p in zip(begin[good].tolist(), end[good].tolist(), q[good].tolist(), strict=True)
                    if _smallest(ids, b, p)]
            for b, e, p in sorted(set(rows)):
                out.append(np.array([owner[b], b - bounds[owner[b]], e - b, p]))
                further = covered[0, b:e] < e
                covered[0, b:e][further] = e
                covered[1, b:e][further] = p
        size *= 2
    if not out:
        return np.zeros((0, 4), np.int64)
    found = np.stack(out)
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Original places of a document's words where every tenth document is made periodic from a place on; None for the others."""
    if doc_id is None or not n:
        return None
    h = crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Mask of the words that no run holds after its first period; rows of start, length, period."""
    keep = np.ones(n, bool)
    for start, length, period in found.tolist():
        keep[start + period:start + length] = False
    return keep


def periodic_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    order: Callable[[int | None, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """``<doc_id>, runs, collapsed`` per row: all runs (``start, length, period``) and the text without later periods.

    ``order(id, n_words)`` may give other places for the words before the search.
    """
    kept = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    entry = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([T.StructField(doc_id, kept.schema["_id"].dataType), T.StructField("runs", T.ArrayType(entry)),
                           T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                hashes, _, _, bounds = word_hashes(part.column(1), lower=False)
                ids = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
                moved = {}
                for i, key in enumerate(part.column(0).to_pylist() if order else []):
                    places = order(key, int(bounds[i + 1] - bounds[i]))
                    if places is not None:
                        moved[i] = places
                        ids[bounds[i]:bounds[i + 1]] = ids[bounds[i]:bounds[i + 1]][places]
                found = runs(ids, bounds)
                cuts = np.searchsorted(found[:, 0], np.arange(part.num_rows + 1))
                texts = part.column(1).to_pylist()
                collapsed = []
                for i, body in enumerate(texts):
                    words = (body or "").encode().split()  # at the six ASCII blanks
                    if i in moved:
                        words = [words[j] for j in moved[i]]
                    own = found[cuts[i]:cuts[i + 1], 1:]
                    if len(own):
                        words = [words[j] for j in np.flatnonzero(kept_words(len(words), own))]
                    collapsed.append(b" ".join(words).decode())
                entries = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, c])) for c in (1, 2, 3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), entries), pa.array(collapsed, pa.string())],
                    names=schema.names)

    return kept.mapInArrow(run, schema)


def strongest(found: list[dict]) -> dict | None:
    """The run with most periods, by exact comparison; ties: the first, then the shorter period."""
    return min(found, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order=repeated_tail) -> DataFrame:
    """``<doc_id>, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` per row."""
    rows = periodic_runs(docs, doc_id, text, order)
    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]
    schema = T.StructType([rows.schema.fields[0], *[T.StructField(n, T.LongType()) for n in numbers],
                           T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found, collapsed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                best = strongest(found)
                lines = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in found)
                out.append((
                    len(found), *([best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]] if best else [None] * 4),
                    hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[i] for r in out], pa.int64() if i < 5 else pa.string()) for i in range(7)]], names=schema.names)

    return rows.mapInArrow(run, schema)

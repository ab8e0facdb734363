"""Benchmark decontamination by SimHash windows of the items' sizes.

An item and each window of a document get a 128-bit SimHash of their word bigrams (single words for windows under five
words). Window sizes are a geometric grid that covers the items' lengths, and windows of a size start every eighth of it. A
multi-index of the items' fingerprints, eight blocks of 16 bits with all values within three bits of each, finds every
item within ``RADIUS`` = 31 bits of a window: of 31 differing bits some block has at most three. Candidates are then
verified exactly: the weighted Jaccard similarity of 5-word shingles, weights being their counts, between the item and every
window of exactly the item's length around the candidate.

Items are read in passes of bounded number and bytes, each pass over all documents; only a pass's items are sent out.

Defined cases: null or empty texts and texts without words match nothing; a document shorter than a window is one window;
items under five words have one shingle and match equal words only; repeated rows and equal items each give their rows;
rows without an id stay and match under a null id; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copycensus.llm.common import packed
from copycensus.llm.hashing import mix, shingles, slices, word_hashes
from copycensus.session import materialize

WIDTH = 5
RADIUS = 31
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 16, 3
#: Items, and bytes of their texts, in one pass over the documents.
PASS_ITEMS = 20_000
PASS_BYTES = 16 << 20
RATIO = 1.2
#: Window starts handled at once.
STARTS = 16_384


def size_class(n_words: int) -> int:
    """The window size for an item: a number of the grid nearest by ratio; sizes under eight are their own."""
    return n_words if n_words < 8 else round(8 * RATIO ** round(math.log(n_words / 8, RATIO)))


def stride(size: int) -> int:
    return max(1, size // 8)


def gram(size: int) -> int:
    return 1 if size < WIDTH else 2


def _running(features: np.ndarray, most: int) -> np.ndarray:
    """Running counts of set bits, 128 per feature, for windows of up to ``most`` features.

    Counts are 8-bit lanes (wider for longer windows) of 64-bit sums: a difference of two sums is exact in every lane, as no
    lane of a window overflows, whatever the running sums themselves have carried.
    """
    both = np.stack([features, mix(features ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1)
    bits = np.unpackbits(both.view(np.uint8), axis=1)
    lanes = bits if most < 1 << 8 else bits.astype(np.uint16 if most < 1 << 16 else np.uint32)
    sums = np.ascontiguousarray(lanes).view(np.uint64)
    out = np.zeros((len(features) + 1, sums.shape[1]), np.uint64)
    np.cumsum(sums, axis=0, out=out[1:])
    return out


def _fingerprints(running: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Majority bits of the features in [start, stop), as two 64-bit numbers."""
    lane = {16: np.uint8, 32: np.uint16, 64: np.uint32}[running.shape[1]]
    ones = (running[stop] - running[start]).view(lane)
    return np.packbits(ones > ((stop - start) // 2).astype(lane)[:, None], axis=1).view(np.uint64)


def fingerprint(words: np.ndarray) -> np.ndarray:
    features = shingles(words, gram(len(words)))
    return _fingerprints(_running(features, len(features)), np.array([0]), np.array([len(features)]))[0]


class Index:
    """Multi-index of the fingerprints of items of one window size."""

    masks = np.array([sum(1 << b for b in c) for k in range(BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), k)], np.uint32)

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        keys = prints.view(np.uint16).reshape(len(prints), BLOCKS).astype(np.uint32)
        self.first, self.items, self.used = [], [], []
        for b in range(BLOCKS):
            values = (keys[:, b][:, None] ^ self.masks[None, :]).ravel()
            owner = np.repeat(np.arange(len(prints), dtype=np.int32), len(self.masks))
            order = np.argsort(values, kind="stable")
            self.items.append(owner[order])
            self.first.append(np.searchsorted(values[order], np.arange((1 << BLOCK_BITS) + 1)).astype(np.int32))
            self.used.append(np.diff(self.first[-1]) > 0)

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, item and distance of all pairs within RADIUS; each pair once."""
        keys = prints.view(np.uint16).reshape(len(prints), BLOCKS)
        windows, items = [], []
        for b in range(BLOCKS):
            some = np.flatnonzero(self.used[b][keys[:, b]])
            at = keys[some, b].astype(np.int64)
            low = self.first[b][at]
            n = self.first[b][at + 1] - low
            owner = np.repeat(some, n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            found = self.items[b][at]
            near = np.bitwise_count(prints[owner] ^ self.prints[found]).sum(axis=1) <= RADIUS
            windows.append(owner[near])
            items.append(found[near])
        pairs = np.unique(np.concatenate(windows).astype(np.int64) * len(self.prints) + np.concatenate(items))
        window, item = np.divmod(pairs, len(self.prints))
        return window, item, np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1)


class Items:
    """A pass's items with an index per window size."""

    def __init__(self, ids: list, texts: list[str]):
        hashes, _, _, bounds = word_hashes(pa.array(texts, pa.string()))
        self.words = [hashes[bounds[i]:bounds[i + 1]] for i in range(len(texts))]
        self.ids = [i for i, w in zip(ids, self.words, strict=True) if len(w)]
        self.words = [w for w in self.words if len(w)]
        # Distinct shingles in order, and their counts.
        self.shingles = [np.unique(shingles(w, min(WIDTH, len(w))), return_counts=True) for w in self.words]
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            by_size.setdefault(size_class(len(w)), []).append(i)
        self.sizes = {s: (np.array(own), Index(np.stack([fingerprint(self.words[i]) for i in own]))) for s, own in sorted(by_size.items())}

    def similarity(self, item: int, words: np.ndarray) -> float:
        own, counts = self.shingles[item]
        width = min(WIDTH, len(self.words[item]))
        theirs, n = np.unique(shingles(words, width), return_counts=True)
        at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
        same = own[at] == theirs
        shared = np.minimum(counts[at[same]], n[same]).sum()
        return float(shared / (counts.sum() + n.sum() - shared)) if len(theirs) else 0.0

    def verify(self, item: int, words: np.ndarray, start: int, size: int) -> tuple[float, int]:
        """Best similarity of the item with a window of its own length near [start, start + size), and its start."""
        n = len(self.words[item])
        reach = n // 4 + stride(size) + abs(n - size)
        starts = range(max(0, start - reach), max(0, min(start + reach, len(words) - n)) + 1)
        return max(((self.similarity(item, words[s:s + n]), -s) for s in starts), default=(0.0, 0))


#: The pass that this worker searches; one at most.
_held: dict[str, Items] = {}


def indexed(name: str, shared: Broadcast) -> Items:
    """A pass's items, indexed once per worker and not once per task; the pass held before is let go."""
    if name not in _held:
        _held.clear()
        _held[name] = Items([i for i, _ in shared.value], [t for _, t in shared.value])
    return _held[name]


def _windows(begin: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop words of all windows of a size: one per stride and one at each text's end."""
    room = end - begin - size
    n = np.where(end > begin, np.maximum(room, 0) // stride(size) + 1, 0)
    owner = np.repeat(np.arange(len(begin)), n)
    starts = begin[owner] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * stride(size)
    last = np.flatnonzero((room > 0) & (room % stride(size) > 0))
    starts, owner = np.concatenate([starts, begin[last] + room[last]]), np.concatenate([owner, last])
    order = np.argsort(starts, kind="stable")
    return starts[order], np.minimum(starts[order] + size, end[owner[order]])


def matches(items: Items, hashes: np.ndarray, bounds: np.ndarray, percent: int) -> dict[tuple[int, int], tuple]:
    """Best match by (text, item): similarity, start word and Hamming distance."""
    best: dict[tuple[int, int], tuple] = {}
    plans = {s: _windows(bounds[:-1], bounds[1:], s) for s in items.sizes}
    longest = max(items.sizes, default=0)
    step = max(STARTS, longest)
    for low in range(0, len(hashes), step):
        part = hashes[low:low + step + longest]
        running = {}
        for size, (starts, stops) in plans.items():
            a, b = np.searchsorted(starts, [low, low + step])
            if a == b:
                continue
            g = gram(size)
            if g not in running:
                running[g] = _running(shingles(part, g), longest)
            start, stop = starts[a:b] - low, stops[a:b] - low - g + 1
            whole = stop > start
            start, stop = start[whole], stop[whole]
            own, index = items.sizes[size]
            window, item, distance = index.search(_fingerprints(running[g], start, stop))
            for w, i, d in zip((start[window] + low).tolist(), own[item].tolist(), distance.tolist(), strict=True):
                text = int(np.searchsorted(bounds, w, side="right")) - 1
                if best.get((text, i), (0,))[0] == 1.0:
                    continue
                words = hashes[bounds[text]:bounds[text + 1]]
                score, at = items.verify(i, words, w - int(bounds[text]), size)
                if 100 * score >= percent and (score, at) > best.get((text, i), (0, 0))[:2]:
                    best[text, i] = (score, at, d)
    return best


def item_passes(items: DataFrame, item_id: str, text: str) -> Iterator[list]:
    """The items in passes of bounded number and bytes, brought to the driver one pass at a time."""
    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    passes = max(math.ceil(size["n"] / PASS_ITEMS), math.ceil(size["bytes"] / PASS_BYTES))
    if passes > 1:
        rows = materialize(rows)
    for k in range(passes):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()]


def contaminated(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", percent: int = 75,
) -> DataFrame:
    """``doc_id, item_id, similarity, start_word, n_words, hamming``: one row per document row and item that it contains."""
    spark = docs.sparkSession
    kept = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()),
                           T.StructField("similarity", T.DoubleType()), T.StructField("start_word", T.LongType()),
                           T.StructField("n_words", T.LongType()), T.StructField("hamming", T.LongType())])
    arrow = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()),
                       ("start_word", pa.int64()), ("n_words", pa.int64()), ("hamming", pa.int64())])
    found = spark.createDataFrame([], schema)
    for rows in item_passes(items, item_id, item_text):
        shared, name = spark.sparkContext.broadcast(rows), uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            own = None
            for batch in batches:
                own = own or indexed(name, shared)
                for part in slices(batch, "text"):
                    hashes, _, _, bounds = word_hashes(part.column(1))
                    ids, out = part.column(0).to_pylist(), []
                    for (row, item), (score, at, d) in matches(own, hashes, bounds, percent).items():
                        out.append({"doc_id": ids[row], "item_id": own.ids[item], "similarity": score, "start_word": -at,
                                    "n_words": len(own.words[item]), "hamming": d})
                    if out:
                        yield pa.RecordBatch.from_pylist(out, arrow)

        # Written pass by pass, so that the driver and the executors hold one pass at a time.
        found = found.union(materialize(kept.mapInArrow(run, schema)))
        shared.unpersist()
    return found


def decontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose document contains no item; rows without an id stay."""
    gone = contaminated(docs, items, doc_id, **options).select(F.col("doc_id").alias("gone")).distinct()
    rows = packed(docs).select("row", F.col("row").getField(doc_id).cast("long").alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")

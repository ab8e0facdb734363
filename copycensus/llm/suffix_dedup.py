"""Removal of long byte strings that occur more than once, by column-wise suffix sorting of many segments at once.

Only equality over a given length matters, or over several lengths in one sort, so the collection is not whole texts but
segments around anchors. An anchor is a place whose ``GRAM``-byte hash is the first least one of a window of the shortest
length; every string of that length holds one, equal strings hold it at the same offset, and a longer string has the anchor of
its beginning. Anchors that share neither the half of the shortest length on their right nor that on their left with another
anchor of the same hash cannot lie in a repeat and are dropped. A segment reaches as far from its anchor as a string of the
longest length can, and is filled up with 0xFF, which UTF-8 never has, beyond the text.

Segments are dealt out by anchor hash, so a repeat's copies meet in one task. There the collection is sorted column by
column from the right, one symbol per segment and round: the symbols in front of the sorted suffixes are the new part of the
Burrows-Wheeler transform, which goes to an external file; read back, its symbols sorted stably give the next order (the LF
step), and the common prefixes with the neighbours follow from range minima of the last round. Columns, transform, order and
prefixes are sequential files in the task's own temporary folder. A string repeats where a neighbour shares its length. A
departure from the textbook form: a round is compared with itself only and earlier rounds are not merged in, because equal
strings start in the same column; so of the transform only the last round's part is read again.

A hash with very many anchors is dealt out over several tasks; what each finds unique or first is compared across them by
128-bit hashes of the strings themselves.

All places of a repeat go, the first too. Defined cases: a null text is empty; texts shorter than the length lose nothing;
equal texts of that length lose everything; repeated rows are equal texts, each with its row in the result; other columns
pass through under any name (``without_repeats``) or are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copycensus.llm.hashing import ByteRuns, byte_hashes, first_least, slices, utf8
from copycensus.session import materialize

LENGTH = 400
#: A passage of 50 words: words and blanks of 243 bytes or more in 95 of 100 documents, see the README.
PASSAGE = 200
GRAM = 32
#: Segments in one task on average; an anchor hash with more than HOT_SEGMENTS is dealt out in parts of SALT_SEGMENTS.
TASK_SEGMENTS = 10_000
HOT_SEGMENTS = 40_000
SALT_SEGMENTS = 10_000
FILL = 0xFF


@dataclass(frozen=True)
class Shape:
    """Lengths of the strings looked for, in ascending order, and what follows from them."""

    lengths: tuple[int, ...] = (LENGTH,)

    def __post_init__(self):
        if not self.lengths or self.lengths[0] < 2 * GRAM or list(self.lengths) != sorted(set(self.lengths)):
            raise ValueError(f"Lengths ascend from {2 * GRAM} on; got {self.lengths}.")

    @cached_property
    def least(self) -> int:
        return self.lengths[0]

    @cached_property
    def left(self) -> int:
        """Bytes in front of an anchor; so many places before it may be a string's start."""
        return self.least - GRAM

    @cached_property
    def right(self) -> int:
        return self.lengths[-1]

    @cached_property
    def wide(self) -> int:
        return self.left + self.right

    @cached_property
    def half(self) -> int:
        """A string reaches this far from its anchor on one side at least."""
        return self.least // 2


def anchors(data: np.ndarray, shape: Shape = Shape()) -> tuple[np.ndarray, np.ndarray]:  # noqa: B008
    """Anchors of one text: grams that are the first least ones of some window.

    Rows of hash, place, the hashes of what lies right and left of it (0 where the text ends before), and the first and the
    last start of the strings whose anchor it is, so that each string has one anchor; and byte ranges
    that repeat for certain. Of anchors whose whole segment occurs twice in the text one is kept: all strings of such a
    segment repeat, so its places are ranges at once.
    """
    none = np.zeros((0, 6), np.int64), np.zeros((0, 2), np.int64)
    if len(data) < shape.least:
        return none
    text = ByteRuns(data)
    grams = text.every(GRAM)
    at, low, high = first_least(grams, shape.least - GRAM + 1)
    keep = np.ones(len(at), bool)
    again = at[:0]
    inner = np.flatnonzero((at >= shape.left) & (at + shape.right <= len(data)))
    if len(inner) > 1:
        _, first, which, n = np.unique(text.at(at[inner] - shape.left, shape.wide), return_index=True, return_inverse=True, return_counts=True)
        again = at[inner[n[which] > 1]]
        keep[inner] = False
        keep[inner[first]] = True
    at, low, high = at[keep], low[keep], high[keep]
    half = shape.half
    right = np.where(at + half <= len(data), text.at(np.minimum(at, len(data) - half), half), 0)
    left = np.where(at >= half, text.at(np.maximum(at - half, 0), half) ^ np.uint64(1), 0)
    rows = np.stack([grams[at].view(np.int64), at, right.view(np.int64), left.view(np.int64), low, high], axis=1)
    return rows, runs(np.stack([again - shape.left, again + shape.right], axis=1))


def runs(ranges: np.ndarray) -> np.ndarray:
    """Maximal runs of ranges (rows of start and end)."""
    if not len(ranges):
        return np.zeros((0, 2), np.int64)
    x = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(x[:, 1])
    new = np.concatenate([[True], x[1:, 0] > reach[:-1]])
    return np.stack([x[new, 0], np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])], axis=1)


def string_keys(segments: np.ndarray, row: np.ndarray, at: np.ndarray, length: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash for the strings of ``length`` bytes at the given rows (ascending) and columns; few rows at a time."""
    keys = np.zeros((2, len(row)), np.int64)
    wide = segments.shape[1]
    for low in range(0, len(segments) if len(row) else 0, rows):
        a, b = np.searchsorted(row, [low, low + rows])
        if a < b:
            flat = segments[low:low + rows].ravel()
            starts = (row[a:b] - low) * wide + at[a:b]
            keys[0, a:b] = byte_hashes(flat, length, starts).view(np.int64)
            keys[1, a:b] = byte_hashes(flat ^ np.uint8(91), length, starts).view(np.int64)
    return keys[0], keys[1]


def _range_minima(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minimum of values[left..right], both included and left <= right."""
    out = np.empty(len(left), values.dtype)
    power = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    level, width = values, 1
    for k in range(int(power.max(initial=-1)) + 1):
        mine = np.flatnonzero(power == k)
        out[mine] = np.minimum(level[left[mine]], level[right[mine] - width + 1])
        level = np.minimum(level[:-width], level[width:])
        width *= 2
    return out


def repeated_columns(
    segments: np.ndarray, lengths: tuple[int, ...], last_start: int, with_first: bool = True,
) -> tuple[list[np.ndarray], list[np.ndarray] | None]:
    """By length: for each segment and start column up to ``last_start``, whether another segment has the same bytes there,
    and, if asked, whether this one is the first of its equals in suffix order."""
    m, wide = segments.shape
    repeated = [np.zeros((m, last_start + 1), bool) for _ in lengths]
    first = [np.zeros((m, last_start + 1), bool) for _ in lengths] if with_first else None
    with tempfile.TemporaryFile() as columns, tempfile.TemporaryFile() as state, tempfile.TemporaryFile() as transform:
        for at in range(wide - 1, -1, -1):  # columns lie in the order in which they are read
            columns.write(np.ascontiguousarray(segments[:, at]).tobytes())
        columns.seek(0)
        state.write(np.arange(m, dtype=np.int32).tobytes() + np.full(m, wide, np.int16).tobytes())
        for at in range(wide - 1, -1, -1):
            state.seek(0)
            order, common = np.frombuffer(state.read(4 * m), np.int32), np.frombuffer(state.read(2 * m), np.int16)
            new = transform.seek(0, 2)
            transform.write(np.frombuffer(columns.read(m), np.uint8)[order].tobytes())
            transform.seek(new)
            symbols = np.frombuffer(transform.read(m), np.uint8)
            step = np.argsort(symbols, kind="stable")
            order, symbols = order[step], symbols[step]
            same = np.flatnonzero((symbols[1:] == symbols[:-1]) & (symbols[1:] != FILL)) + 1
            longer = np.zeros(m, np.int16)
            longer[same] = np.minimum(_range_minima(common, step[same - 1] + 1, step[same]), wide - 1) + 1 if at < wide - 1 else 1
            state.seek(0)
            state.write(order.astype(np.int32).tobytes() + longer.tobytes())
            if at <= last_start:
                for i, length in enumerate(lengths):
                    equal = longer >= length
                    repeated[i][order, at] = equal | np.append(equal[1:], False)
                    if with_first:
                        first[i][order, at] = ~equal
    return repeated, first


def _segments(texts: DataFrame, shape: Shape) -> DataFrame:
    """Rows ``a, b, place, low, high, task, salted, segment`` from texts with their lists of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = utf8(part.column(part.schema.get_field_index("text")))
                lists = part.column(part.schema.get_field_index("found"))
                owner, flat = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy()), lists.flatten()
                place = flat.field("place").to_numpy()
                low, high = bounds[owner], bounds[owner + 1]
                for at in range(0, len(owner), 4096):
                    s = slice(at, at + 4096)
                    index = (low[s] + place[s])[:, None] + np.arange(-shape.left, shape.right)
                    inside = (index >= low[s][:, None]) & (index < high[s][:, None])
                    cut = np.where(inside, data[np.where(inside, index, 0)], FILL).astype(np.uint8)
                    n = len(cut)
                    packed = pa.Array.from_buffers(pa.large_binary(), n, [
                        None, pa.py_buffer(np.arange(n + 1, dtype=np.int64) * shape.wide), pa.py_buffer(cut)])
                    rows = pa.array(owner[s])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(part.schema.get_field_index(c)).take(rows) for c in "ab"]
                        + [pa.array(place[s]), flat.field("low").slice(at, n), flat.field("high").slice(at, n), flat.field("task").slice(at, n), flat.field("salted").slice(at, n), packed.cast(pa.binary())],
                        names=["a", "b", "place", "low", "high", "task", "salted", "segment"])

    return texts.mapInArrow(run, "a long, b long, place long, low long, high long, task long, salted boolean, segment binary")


def _classes(segments: np.ndarray, rows: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row, class and class sizes of equal segments, by 128 bits of hash; few rows at a time."""
    keys = np.zeros((len(segments), 2), np.uint64)
    for low in range(0, len(segments), rows):
        flat = segments[low:low + rows].ravel()
        starts = np.arange(0, len(flat), segments.shape[1])
        keys[low:low + rows, 0] = byte_hashes(flat, segments.shape[1], starts)
        keys[low:low + rows, 1] = byte_hashes(flat ^ np.uint8(91), segments.shape[1], starts)
    _, one, which, n = np.unique(keys, axis=0, return_index=True, return_inverse=True, return_counts=True)
    return one, which.ravel(), n


def _repeats(group: pa.Table, shape: Shape) -> pa.Table:
    """Byte ranges of repeats in one task's collection; for salted anchors also the strings to compare across tasks."""
    a, b, place, lowest, highest = (group.column(c).to_numpy() for c in ("a", "b", "place", "low", "high"))
    _, own = np.unique(np.stack([a, b, place], axis=1), axis=0, return_index=True)
    salted = group.column("salted").to_numpy(zero_copy_only=False).astype(bool)[own]
    packed = group.column("segment").combine_chunks()
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1]
    segments = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].reshape(-1, shape.wide)
    a, b, place, lowest, highest = a[own], b[own], place[own], lowest[own], highest[own]
    # Equal segments are sorted once; all their strings that lie within the text repeat.
    one, which, n = _classes(segments)
    which = which[own]
    used, which, n = np.unique(which, return_inverse=True, return_counts=True)
    distinct = segments[one[used]]
    del segments, packed
    repeated, first = repeated_columns(distinct, shape.lengths, shape.left, with_first=bool(salted.any()))
    salted_class = np.zeros(len(distinct), bool)
    salted_class[which[salted]] = True
    by_class = np.argsort(which, kind="stable")
    left, firsts = shape.left, np.cumsum(n) - n
    edge = lambda m: np.zeros((m, 1), np.int8)
    out = []
    for i, length in enumerate(shape.lengths):
        runs_of, begins, ends, srows, sats = [], [], [], [], []
        for low in range(0, len(distinct), 2048):
            part, block = slice(low, low + 2048), distinct[low:low + 2048]
            within = (block[:, :left + 1] != FILL) & (block[:, length - 1:length + left] != FILL)
            hit = repeated[i][part] | (within & (n[part] > 1)[:, None])
            change = np.diff(np.concatenate([edge(len(block)), hit.view(np.int8), edge(len(block))], axis=1), axis=1)
            row, start = np.nonzero(change == 1)
            runs_of.append(row + low)
            begins.append(start)
            ends.append(np.nonzero(change == -1)[1])
            if first is not None:
                # First of its equals: every distinct string of a salted anchor once.
                row, at = np.nonzero(first[i][part] & within & salted_class[part][:, None])
                srows.append(row + low)
                sats.append(at)
        row, start, stop = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (runs_of, begins, ends))
        # Every place of a segment has the segment's runs.
        many = n[row]
        which_run = np.repeat(np.arange(len(row)), many)
        behind = np.arange(len(which_run)) - np.repeat(np.cumsum(many) - many, many)
        at = by_class[np.repeat(firsts[row], many) + behind]
        # A string is reported by its own anchor only.
        begin = np.maximum(place[at] - left + start[which_run], lowest[at])
        last = np.minimum(place[at] - left + stop[which_run] - 1, highest[at])
        some = begin <= last
        at, begin, end = at[some], begin[some], last[some] + length
        srow, sat = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (srows, sats))
        sat_at = by_class[firsts[srow]]
        sbegin = place[sat_at] - left + sat
        some = (sbegin >= lowest[sat_at]) & (sbegin <= highest[sat_at])
        sat_at, sbegin = sat_at[some], sbegin[some]
        keys = string_keys(distinct, srow[some], sat[some], length)
        none = pa.nulls(len(at), pa.int64())
        out.append(pa.table({
            "a": np.concatenate([a[at], a[sat_at]]), "b": np.concatenate([b[at], b[sat_at]]),
            "start": np.concatenate([begin, sbegin]).astype(np.int64), "end": np.concatenate([end, sbegin + length]).astype(np.int64),
            "length": np.full(len(at) + len(sat_at), length, np.int32),
            "key_a": pa.concat_arrays([none, pa.array(keys[0])]), "key_b": pa.concat_arrays([none, pa.array(keys[1])]),
        }))
    return pa.concat_tables(out)


def repeated_ranges(texts: DataFrame, lengths: tuple[int, ...] = (LENGTH,)) -> DataFrame:
    """``a, b, start, end, length``: repeated byte ranges, may overlap, of texts ``a, b, text`` with text hash (a, b)."""
    kept, shape = texts.select("a", "b", "text"), Shape(tuple(lengths))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = utf8(part.column(2))
                found = [anchors(data[bounds[i]:bounds[i + 1]], shape) for i in range(part.num_rows)]
                own = [[{"start": x, "end": y} for x, y in r.tolist()] for _, r in found]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x, _ in found])]).astype(np.int32))
                rows = np.concatenate([x for x, _ in found])
                pairs = pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(rows[:, k])) for k in range(6)], names=["hash", "place", "right", "left", "low", "high"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(ends, pairs),
                     pa.array(own, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["a", "b", "n_bytes", "found", "own"])

    marked = kept.mapInArrow(
        find, "a long, b long, n_bytes long, found array<struct<hash:long,place:long,right:long,left:long,low:long,high:long>>, own array<struct<start:long,end:long>>")
    classes = materialize(marked.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("found").alias("found"), F.first("own").alias("own")))
    single = classes.select("a", "b", F.explode("found").alias("_f")).select("a", "b", "_f.*")
    # A string holds all of the half on the right or on the left of its anchor; anchors that share neither are dropped.
    twice = single.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    sides = single.join(twice, "hash", "left_semi").select("a", "b", "hash", "place", "low", "high", F.explode(F.array("right", "left")).alias("side")).where("side <> 0")
    shared = sides.groupBy("hash", "side").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    single = materialize(sides.join(shared, ["hash", "side"]).select("a", "b", "hash", "place", "low", "high").distinct())
    often = materialize(single.groupBy("hash").agg(F.count(F.lit(1)).alias("n")))
    tasks = (often.agg(F.sum("n")).first()[0] or 0) // TASK_SEGMENTS + 1
    salts = F.when(F.col("n") > HOT_SEGMENTS, F.floor(F.col("n") / SALT_SEGMENTS) + 1).otherwise(1).cast("long")
    # Only a hash with more than HOT_SEGMENTS anchors has salts, so this list is short and no anchor is sent to its hash.
    hot = often.withColumn("salts", salts).where("salts > 1").drop("n")
    salts = F.coalesce(F.col("salts"), F.lit(1).cast("long"))
    placed = single.join(hot, "hash", "left").select(
        "a", "b", F.struct(
            "place", "low", "high",
            F.when(salts == 1, F.pmod(F.col("hash"), F.lit(tasks)))
            .otherwise(F.lit(tasks) + F.pmod(F.xxhash64("hash", F.pmod(F.xxhash64("a", "b", "place"), salts)), F.lit(1 << 40)))
            .alias("task"),
            (salts > 1).alias("salted")).alias("_p"))
    wanted = placed.groupBy("a", "b").agg(F.collect_list("_p").alias("found"))
    # Segments are cut once per text: copies are combined before the shuffle and never expanded.
    distinct = kept.groupBy("a", "b").agg(F.first("text").alias("text"))
    ranges = _segments(distinct.join(wanted, ["a", "b"]).select("a", "b", "text", "found"), shape).groupBy("task").applyInArrow(
        lambda group: _repeats(group, shape), "a long, b long, start long, end long, length int, key_a long, key_b long")
    ranges = materialize(ranges)
    across = ranges.where("key_a IS NOT NULL").distinct()  # a place counts once
    keys = ["key_a", "key_b", "length"]
    again = across.join(across.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), keys)
    every = F.explode(F.array(*[F.lit(x) for x in shape.lengths])).alias("length")
    copies = classes.where(F.col("copies") > 1).select("a", "b", F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"), every).where("end >= length")
    columns = ["a", "b", "start", "end", "length"]
    own = classes.select("a", "b", F.explode("own").alias("_o")).select("a", "b", "_o.start", "_o.end", every)
    return ranges.where("key_a IS NULL").select(*columns).union(again.select(*columns)).union(own).union(copies)


def with_ranges(docs: DataFrame, text: str = "text", lengths: tuple[int, ...] = (LENGTH,)) -> DataFrame:
    """``row, body, ranges``: each row as one struct, so that no name of its columns matters, its text, and the repeated byte
    ranges of the text with their lengths (null for none)."""
    body = F.col(f"`{text}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), body.alias("body"))
    body = F.coalesce(F.col("body"), F.lit(""))
    hashed = rows.withColumns({"a": F.xxhash64(body), "b": F.xxhash64(F.lit(7), body)})
    ranges = repeated_ranges(hashed.select("a", "b", body.alias("text")), lengths)
    by_text = ranges.groupBy("a", "b").agg(F.collect_list(F.struct("start", "end", "length")).alias("ranges"))
    return hashed.join(by_text, ["a", "b"], "left").select("row", "body", "ranges")


def merged(ranges: list[dict] | None, length: int) -> np.ndarray:
    """Maximal runs of the ranges of one length, as rows of start and end."""
    return runs(np.array([(r["start"], r["end"]) for r in ranges or [] if r["length"] == length], np.int64).reshape(-1, 2))


def kept_bytes(data: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(data)]
    return b"".join([data[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2)])


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, passage: int | None = PASSAGE) -> DataFrame:
    """``<doc_id>, n_bytes, n_removed, n_spans, kept_sha256`` per row, and from the same sort ``n_passage_bytes`` and
    ``n_passages``: bytes and maximal runs covered by repeats of the shorter length ``passage`` (left out if it is None)."""
    lengths = (length,) if passage is None else (passage, length)
    rows = with_ranges(docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), text, lengths).select(F.col("row").getField(doc_id).alias(doc_id), "body", "ranges")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["n_passage_bytes", "n_passages"] if passage is not None else [])]
    types = [T.StringType() if n == "kept_sha256" else T.LongType() for n in names]
    schema = T.StructType([rows.schema.fields[0], *[T.StructField(n, t) for n, t in zip(names, types, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (body or "").encode()
                spans, *short = [merged(ranges, x) for x in reversed(lengths)]
                covered = [n for x in short for n in (int((x[:, 1] - x[:, 0]).sum()), len(x))]
                out.append((len(data), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(kept_bytes(data, spans)).hexdigest(), *covered))
            columns = [pa.array([r[i] for r in out], pa.string() if i == 3 else pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeats of ``length`` bytes cut from the text. Characters that are removed in part stay, so texts stay valid."""
    rows = with_ranges(docs, text, (length,)).select("row", "ranges")
    schema = docs.schema
    at = schema.names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts = batch.column(0).flatten(), []
            for body, ranges in zip(columns[at].to_pylist(), batch.column(1).to_pylist(), strict=True):
                if body is not None and ranges:
                    data, spans = body.encode(), merged(ranges, length)
                    for s in spans:
                        while s[0] < s[1] and data[s[0]] & 0xC0 == 0x80:
                            s[0] += 1
                        while s[0] < s[1] < len(data) and data[s[1]] & 0xC0 == 0x80:
                            s[1] -= 1
                    body = kept_bytes(data, spans).decode()
                texts.append(body)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)

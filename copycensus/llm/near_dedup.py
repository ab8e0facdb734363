"""MinHash near-deduplication with bottom-k sketches from one hash function.

Documents with equal sets of 5-word shingles form a class. A class keeps the ``SKETCH`` least hashes of its set. The
inverted lists of these values generate candidates: of its retained values a class enters only its rarest into lists, as
many as are needed for two classes with enough common values to meet in a list (the prefix filter). Each list has a hub, the
class with most shared values, and a hub's group is all classes of its lists; so two classes that meet in a list are in one
group, once. A group is cut into blocks of bounded bytes and pairs of blocks are compared in a task: overlaps of sketches,
then the union-sketch estimate, then the exact Jaccard similarity of whole sets. A task returns the links of a spanning
forest, never all pairs, and links become components.

Why nothing is lost: of two classes with similarity J >= 0.75, about J * 32 of the 32 least values of their union are in
both sketches. ``LEAST_SHARED`` = 14 is four standard deviations below that, and sets of up to 24 shingles are handled by
their exact overlap, so a pair is missed with a probability below 1e-4 at J = 0.75 and near 1e-6 at 0.8.

Defined cases: a null or empty text, or one without words, has no shingle and is linked with nothing; a text of fewer than
five words has its whole sequence as one shingle; repeated rows are equal documents and each returns a row; rows without an
id stay and are linked with nothing; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copycensus.llm.common import packed
from copycensus.llm.components import components
from copycensus.llm.hashing import mix, shingles, slices, word_hashes
from copycensus.session import materialize

WIDTH = 5
SKETCH = 32
LEAST_PERCENT = 75
LEAST_SHARED = 14
#: Sets of up to this size meet others of up to SKETCH values only, whose sketches are whole.
SMALL_SET = 24
#: Bytes of sets in one block; a task holds two blocks.
BLOCK_BYTES = 16 << 20
#: Largest bit table (bytes) for the exact comparison; beyond it sets are intersected pair by pair, with the same result.
BIT_BYTES = 64 << 20


def shingle_set(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingles of a text's word hashes."""
    if 0 < len(hashes) < width:
        return mix(np.array([shingles(hashes, len(hashes))[0] + np.uint64(len(hashes))], np.uint64))
    return np.unique(shingles(hashes, width))


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, sig_a, sig_b, sketch``: equal sets have equal counts and signatures."""
    kept = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, _, _, bounds = word_hashes(part.column(1))
                n, a, b, least = [], [], [], []
                for i in range(part.num_rows):
                    s = shingle_set(hashes[bounds[i]:bounds[i + 1]])
                    n.append(len(s))
                    a.append(s.sum(dtype=np.uint64))
                    b.append(mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))
                    least.append(_as_long(s[:SKETCH]))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(x) for x in least])]).astype(np.int32)),
                    pa.array(np.concatenate(least) if least else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(_as_long(np.array(a, np.uint64))),
                     pa.array(_as_long(np.array(b, np.uint64))), lists],
                    names=["doc_id", "n_shingles", "sig_a", "sig_b", "sketch"])

    return kept.mapInArrow(run, "doc_id long, n_shingles long, sig_a long, sig_b long, sketch array<long>")


def meeting_lists(classes: DataFrame) -> DataFrame:
    """``value, class_id, n_shingles, shared``: the list entries of each class under the prefix filter."""
    entries = classes.select("class_id", "n_shingles", F.explode("sketch").alias("value"))
    spread = entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = entries.join(spread, "value").groupBy("class_id", "n_shingles").agg(
        F.array_sort(F.collect_list(F.struct("df", "value"))).alias("common"))
    size = F.least(F.col("n_shingles"), F.lit(SKETCH))
    least = F.when(F.col("n_shingles") <= SMALL_SET, F.ceil(F.col("n_shingles") * 0.75)).otherwise(F.lit(LEAST_SHARED))
    # Values that no other class retains come first in the order of rarity and meet nobody.
    entered = (size - least + 1) - (size - F.size("common"))
    return own.where(entered > 0).select(
        "class_id", "n_shingles", F.size("common").alias("shared"),
        F.explode(F.slice("common", F.lit(1), entered.cast("int"))).alias("_c"),
    ).select(F.col("_c.value").alias("value"), "class_id", "n_shingles", "shared")


def hub_groups(lists: DataFrame) -> DataFrame:
    """``hub, class_id, n_shingles``: distinct members of the groups that have two or more."""
    hub = lists.groupBy("value").agg(
        F.max_by("class_id", F.struct(F.col("shared"), -F.col("class_id"))).alias("hub"), F.count(F.lit(1)).alias("_n")
    ).where("_n > 1").drop("_n")
    return lists.join(hub, "value").select("hub", "class_id", "n_shingles").distinct()


def forest(ids: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Links of each node to the root of its tree, from index pairs."""
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in pairs.tolist():
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(int(ids[i]), int(ids[root(i)])) for i in range(len(ids)) if parent[i] != i]


def _bits(sets: list[np.ndarray]) -> np.ndarray | None:
    """A bit row per set over the values that at least two of the sets hold; None if the table would be too large."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    common = n[at] > 1
    words = max(1, (int((n > 1).sum()) + 63) // 64)
    if 8 * words * len(sets) > BIT_BYTES:
        return None
    out = np.zeros((len(sets), words), np.uint64)
    at = column[at[common]]
    np.bitwise_or.at(out, (owner[common], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    return out


def union_estimates(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many of the union's ``SKETCH`` least values both sketches hold, for one sketch and many.

    Sketches are padded with the greatest number, which the estimate counts as distinct values behind all others.
    """
    merged = np.sort(np.concatenate([np.broadcast_to(x, others.shape), others], axis=1), axis=1)
    again = (merged[:, 1:] == merged[:, :-1]) & (merged[:, 1:] != _PAD)
    rank = np.arange(1, merged.shape[1]) - np.cumsum(again, axis=1) + 1  # distinct values up to and with this one
    return (again & (rank <= SKETCH)).sum(axis=1)


_PAD = np.uint64((1 << 64) - 1)


def linked_pairs(sets: list[np.ndarray], first: np.ndarray, percent: int) -> np.ndarray:
    """Index pairs with a similarity of at least ``percent``.

    ``first`` marks the first of two blocks, whose members are compared with those of the second; if it marks all, every
    pair is compared.
    """
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    n, sets, first = n[order], [sets[i] for i in order], first[order]
    sketch = np.full((len(sets), SKETCH), _PAD)
    for i, s in enumerate(sets):
        sketch[i, :len(s)] = s[:SKETCH]
    low, whole = _bits([s[:SKETCH] for s in sets]), _bits(sets)
    least = np.where(n <= SMALL_SET, np.ceil(n * percent / 100), LEAST_SHARED)
    stop = np.searchsorted(n, n * 100 // percent, side="right")
    found, both = [], not first.all()
    for i in range(len(sets) - 1):
        others = np.arange(i + 1, stop[i])
        if both:
            others = others[first[others] != first[i]]
        if len(others):
            shared = (np.bitwise_count(low[i] & low[others]).sum(axis=1) if low is not None else
                      np.array([len(np.intersect1d(sketch[i], sketch[j])) for j in others]))
            others = others[shared >= least[i]]
        if len(others):
            others = others[union_estimates(sketch[i], sketch[others]) >= np.minimum(least[i], LEAST_SHARED)]
        if len(others):
            common = (np.bitwise_count(whole[i] & whole[others]).sum(axis=1, dtype=np.int64) if whole is not None else
                      np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in others]))
            hit = others[100 * common >= percent * (n[i] + n[others] - common)]
            found += [(order[i], order[j]) for j in hit]
    return np.array(found, np.int64).reshape(-1, 2)


def group_links(members: DataFrame, docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """``a, b``: forest links within every hub's group; exact on whole sets, block by block."""
    blocks = members.groupBy("hub").agg((F.floor(F.sum("n_shingles") * 8 / BLOCK_BYTES) + 1).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    tasks = members.join(blocks, "hub").withColumn("_own", own).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "class_id", F.struct("hub", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"),
                             (F.col("_own") <= F.col("_other")).alias("first")).alias("task"))
    wanted = tasks.groupBy("class_id").agg(F.collect_list("task").alias("tasks"))
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("class_id"), F.col(f"`{text}`").alias("text")).join(
        wanted.hint("merge"), "class_id")  # one plan at every size: texts are sorted to their tasks, never the tasks sent to all

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, _, _, bounds = word_hashes(part.column(part.schema.get_field_index("text")))
                packed = [shingle_set(hashes[bounds[i]:bounds[i + 1]]).tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("class_id")), pa.array(packed, pa.binary()),
                     part.column(part.schema.get_field_index("tasks"))], names=["class_id", "values", "tasks"])

    schema = "class_id long, values binary, tasks array<struct<hub:long,i:int,j:int,first:boolean>>"
    dealt = texts.mapInArrow(sets, schema).select("class_id", "values", F.explode("tasks").alias("t")).select(
        "class_id", "values", "t.hub", "t.i", "t.j", "t.first")

    def compare(group: pa.Table) -> pa.Table:
        ids = group.column("class_id").to_numpy()
        values = [np.frombuffer(v, np.uint64) for v in group.column("values").to_pylist()]
        same = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        first = np.ones(len(ids), bool) if same else group.column("first").to_numpy(zero_copy_only=False).astype(bool)
        links = forest(ids, linked_pairs(values, first, percent)) if same or not first.all() else []
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return dealt.groupBy("hub", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id, kept`` per document; one document of each component is kept.

    The filters on sketches are made for ``LEAST_PERCENT``; links below it would be lost, so a lower ``percent`` is refused.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent is {percent}; the sketches find links from {LEAST_PERCENT} to 100 only")
    rows = materialize(sketches(docs, doc_id, text))
    keys = ["n_shingles", "sig_a", "sig_b"]
    classes = materialize(rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*keys).agg(
        F.min("doc_id").alias("class_id"), F.first("sketch").alias("sketch")))
    members = materialize(hub_groups(meeting_lists(classes)))
    found = components(group_links(members, docs, doc_id, text, percent))
    labels = classes.select(*keys, "class_id").join(found, F.col("class_id") == F.col("node"), "left").select(
        *keys, "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    linked = rows.drop("sketch").join(labels, keys, "left")
    return linked.select(
        "doc_id", "n_shingles", *[F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id")).alias(c) for c in ("class_id", "component_id")],
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _digest(column: str, a: str, b: str) -> list[Column]:
    """128 bits of a column, as two numbers."""
    return [F.xxhash64(column).alias(a), F.xxhash64(F.lit(7), column).alias(b)]


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose document is kept, one row for each text with words.

    Rows without an id are linked with nothing, but of equal texts left over, by repeated rows or without ids, one row stays:
    the one with the least id.
    """
    gone = near_duplicates(docs, doc_id, text, percent).where("NOT kept").select(F.col("doc_id").alias("gone"))
    # What stays is settled on digests of rows and texts; the rows themselves are shuffled once, to the digests that stay.
    rows = packed(docs).select("row", *_digest("row", "row_a", "row_b"))
    content = F.col("row").getField(text)
    keys = rows.select(
        F.col("row").getField(doc_id).alias("id"), "row_a", "row_b", content.alias("text"),
        F.coalesce(content.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"),
    ).select("id", "row_a", "row_b", "worded", *_digest("text", "text_a", "text_b"))
    left = keys.join(gone, F.col("id").cast("long") == F.col("gone"), "left_anti")
    # Texts without words are no copies of each other.
    same = [F.when(F.col("worded"), F.col(f"text_{x}")).otherwise(F.col(f"row_{x}")).alias(x) for x in "ab"]
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row_a"), F.col("row_b"))
    stay = left.groupBy("worded", *same).agg(F.min(order).alias("first")).select("worded", "first.row_a", "first.row_b")
    # One plan at every size: the rows are sorted to their digests, never the digests sent to all.
    copy = F.row_number().over(W.partitionBy("row_a", "row_b").orderBy("row_a"))
    found = rows.join(stay.hint("merge"), ["row_a", "row_b"]).withColumn("copy", copy)
    return found.where("copy = 1 OR NOT worded").select("row.*")

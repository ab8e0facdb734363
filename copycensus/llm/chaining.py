"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

Equal texts are one class, known by a 64-bit hash of the text. A word is 32 bits of its hash. Seeds are runs of ``SEED`` words that are least by hash in a window of ``WINDOW`` places, so two
texts that share 11 words in a row share a seed: an edit every 12 words leaves one between any two edits. Every place of a
shared seed is joined to the seed's first place in the shortest text of ``MIN_WORDS`` words or more that has it, never to all
others; only the identical place is left out, so a passage that comes again in its own text and every later place of a passage
have rows. Where a seed goes on in steps of equal length under ``MIN_WORDS``, as in a line over and over, its third and later
places are matched with the place one step before: such a run is one chain, not one per place. Runs of ``MIN_WORDS`` words,
the least by hash in ``CONTEXT`` places, are seeds too: a text that quotes less of a passage may stand first for all its short
seeds, but never for these, so two texts that share 47 words in a row meet in a text that has as many.

Seeds are made once and shuffled once, as packed columns: a task packs the seeds of many texts by ranges of their hash, and a
range's packs meet in one task, which keeps what occurs again. A seed with ``HOT_PLACES`` places or more in one pack sends only
its least one there; its other places are dealt out on their own and joined with the seed's one first place afterwards.

A text's matches are chained per partner: a chain's places rise in both texts, each match adds one, the distance between
matches costs ``GAP_COST`` per word, and the best predecessor comes from a Fenwick tree of prefix maxima. Chains are aligned
with the words of both texts, through gaps by a longest common subsequence and outwards over single edits until the texts
differ, and a passage counts with ``MIN_WORDS`` matched words. An alignment that comes to the end of the words at hand is
repeated with ``MORE`` times as many around the chain. Texts themselves are never shuffled, only the 32-bit words of texts
that can hold a passage, once for both sides of an alignment.

Shorter fragments of one text that touch each other and together have as many words count too, unless they lie within longer
passages: copies of one passage may be represented by different texts in its parts.

Defined cases: null, empty and short texts have no passages; equal texts of ``MIN_WORDS`` words are one passage each;
repeated rows of one id and text count once; an id with several texts has the passages of each of them; rows without an id have
no passages of their own; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copycensus.llm.hashing import least_places, mix, shingles, slices, word_hashes
from copycensus.session import materialize

SEED = 7
WINDOW = 5
MIN_WORDS = 40
#: Window of the seeds of MIN_WORDS words; such a seed stands for the SEED words in its middle.
CONTEXT = 8
GAP_COST = 1 / 96
#: Words at hand on both sides of a chain, how many times as many where they are not enough, and equal words that must follow an edit.
REACH = 192
MORE = 16
AFTER_EDIT = 3
#: Seeds of one pack and of one range on average, and places of a seed in a pack from which on it is dealt out.
PACK_SEEDS = 1_000_000
RANGE_SEEDS = 2_000_000
LEAST_RANGES = 64
HOT_PLACES = 8
MATCHES = "array<struct<partner:long,there:int,here:int>>"


class Fenwick:
    """Prefix maxima over ranks, with the index that attains them."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def update(self, rank: int, value: tuple[float, int]) -> None:
        while rank < len(self.best):
            if value > self.best[rank]:
                self.best[rank] = value
            rank += rank & -rank

    def query(self, rank: int) -> tuple[float, int]:
        out = (-1e18, -1)
        while rank:
            if self.best[rank] > out:
                out = self.best[rank]
            rank -= rank & -rank
        return out


def chains(x: list[int], y: list[int], gap_cost: float = GAP_COST) -> list[list[int]]:
    """Indices of the matches of each chain, best chain first; every match is in one chain."""
    order = sorted(range(len(x)), key=lambda i: (x[i], y[i]))
    rank = {v: r for r, v in enumerate(sorted(set(y)), 1)}
    tree, score, before = Fenwick(len(rank)), [0.0] * len(x), [-1] * len(x)
    at = 0
    while at < len(order):
        to = at
        while to < len(order) and x[order[to]] == x[order[at]]:
            to += 1
        for i in order[at:to]:  # matches in one place of x do not follow each other
            value, j = tree.query(rank[y[i]] - 1)
            gain = value - gap_cost * (x[i] + y[i])
            score[i], before[i] = (1 + gain, j) if j >= 0 and gain > 0 else (1.0, -1)
        for i in order[at:to]:
            tree.update(rank[y[i]], (score[i] + gap_cost * (x[i] + y[i]), i))
        at = to
    used, out = [False] * len(x), []
    for i in sorted(range(len(x)), key=lambda i: (-score[i], x[i], y[i])):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of a longest common subsequence; row by row."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int32)
    for w in a:
        step = np.maximum(row[1:], row[:-1] + (b == w))
        row[1:] = np.maximum.accumulate(step)
    return int(row[-1])


def extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """How far two word runs go on together from their beginning: words of a, of b, and matches.

    Goes over one word replaced, left out or put in where ``AFTER_EDIT`` equal words follow.
    """
    i = j = matched = 0
    reach_i = reach_j = 0
    while i < len(a) and j < len(b):
        n = min(len(a) - i, len(b) - j)
        differ = np.flatnonzero(a[i:i + n] != b[j:j + n])
        run = int(differ[0]) if len(differ) else n
        i, j, matched = i + run, j + run, matched + run
        reach_i, reach_j = i, j
        for di, dj in ((1, 1), (1, 0), (0, 1)):
            p, q = a[i + di:i + di + AFTER_EDIT], b[j + dj:j + dj + AFTER_EDIT]
            if len(p) == len(q) == AFTER_EDIT and (p == q).all():
                i, j = i + di, j + dj
                break
        else:
            break
    return reach_i, reach_j, matched


def blocks(x: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and lengths of the runs of a chain's seeds that lie on one diagonal and overlap or touch."""
    new = np.flatnonzero(np.concatenate([[True], (np.diff(x) != np.diff(y)) | (np.diff(x) > width)]))
    last = np.append(new[1:], len(x)) - 1
    return x[new], y[new], x[last] - x[new] + width


def align(a: np.ndarray, b: np.ndarray, places: list[tuple[int, int, int]]) -> tuple[int, int, int, int, int]:
    """Bounds in a and b and matched words of the passage around chained blocks of equal words, each a place in a, one in b and a length."""
    (i, j, _), matched = places[0], 0
    done_i, done_j = i, j
    for p, q, size in places:
        if p < done_i or q < done_j:  # overlaps the blocks so far
            skip = max(done_i - p, done_j - q)
            p, q, size = p + skip, q + skip, size - skip
            if size <= 0:
                continue
        else:
            matched += common_words(a[done_i:p], b[done_j:q])
        matched += int((a[p:p + size] == b[q:q + size]).sum())
        done_i, done_j = p + size, q + size
    left = extend(a[:i][::-1], b[:j][::-1])
    right = extend(a[done_i:], b[done_j:])
    return i - left[0], done_i + right[0], j - left[1], done_j + right[1], matched + left[2] + right[2]


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def steps_back(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place (ascending) of a text's seeds: the seed's place one step before in a run of equal steps, -1 for none.

    The first two places of a run have none; steps are shorter than ``MIN_WORDS``.
    """
    back = np.full(len(at), -1, np.int64)
    order = np.argsort(hashes, kind="stable")
    h, p = hashes[order], at[order]
    step = np.where(h[1:] == h[:-1], p[1:] - p[:-1], 0)
    third = np.flatnonzero((step[1:] == step[:-1]) & (step[1:] > 0) & (step[1:] < MIN_WORDS)) + 2
    back[order[third]] = p[third - 1]
    return back


def seed_places(words: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of one text's words, their places and ``steps_back``; short ones first."""
    words = words.astype(np.uint64)
    short, long = shingles(words, SEED), shingles(words, max(min_words, SEED))
    at, middle = least_places(short, WINDOW), least_places(long, CONTEXT)
    seed = np.concatenate([short[at], mix(long[middle] + np.uint64(1))])
    back = [steps_back(short[at], at), steps_back(long[middle], middle)]
    shift = (max(min_words, SEED) - SEED) // 2
    back[1][back[1] >= 0] += shift
    return seed, np.concatenate([at, middle + shift]), np.concatenate(back)


def _packed(ids: np.ndarray, sizes: np.ndarray, seed: np.ndarray, doc: np.ndarray, place: np.ndarray, ranges: int, hot: int = HOT_PLACES) -> pa.RecordBatch:
    """One row per hash range with the seeds of many texts; one row per hot seed with all its places but the least.

    A place of a hot seed that stands for others in its pack has its highest bit set.
    """
    order = np.argsort(seed, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], seed[order][1:] != seed[order][:-1]])) if len(seed) else np.zeros(0, np.int64)
    many = np.diff(np.append(new, len(seed)))
    stays, mark, rows = np.ones(len(seed), bool), np.zeros(len(seed), np.uint32), []
    for at, n in zip(new[many >= hot].tolist(), many[many >= hot].tolist(), strict=True):
        own = order[at:at + n]
        own = own[np.lexsort((place[own], ids[doc[own]], sizes[doc[own]]))]
        stays[own[1:]] = False
        mark[own[0]] = 1 << 31
        rows.append((int((seed[own[0]] ^ np.uint64(ids[doc[own[0]]] & 0x7FFFFFFF)) % np.uint64(ranges)), int(seed[own[0]].view(np.int64)), None, None,
                     place[own[1:]].astype("<u4").tobytes(), ids[doc[own[1:]]].astype("<i8").tobytes(), None))
    seed, doc, place = seed[stays], doc[stays], place[stays].astype(np.uint32) | mark[stays]
    group = (seed % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(ranges + 1))
    for r in np.flatnonzero(np.diff(bounds)).tolist():
        own = order[bounds[r]:bounds[r + 1]]
        used, local = np.unique(doc[own], return_inverse=True)
        rows.append((r, None, seed[own].astype("<u8").tobytes(), local.astype("<u4").tobytes(), place[own].astype("<u4").tobytes(),
                     ids[used].astype("<i8").tobytes(), sizes[used].astype("<u4").tobytes()))
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(7)], names=["range", "seed", "seeds", "docs", "places", "ids", "sizes"])


def packed_seeds(texts: DataFrame, ranges: int, min_words: int = MIN_WORDS) -> DataFrame:
    """``range, seed, seeds, docs, places, ids, sizes`` as in ``_packed`` from rows ``key, text``."""
    pack, hot = PACK_SEEDS, HOT_PLACES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, seed, doc, place = [], [], [], [], []
        n = docs = 0
        known: set[int] = set()

        def flush() -> pa.RecordBatch:
            out = _packed(*map(np.concatenate, (ids, sizes, seed, doc, place)), ranges, hot)
            for x in (ids, sizes, seed, doc, place):
                x.clear()
            return out

        for batch in batches:
            for part in slices(batch, "text"):
                hashes, _, _, bounds = word_hashes(part.column(1))
                ids.append(part.column(0).to_numpy())
                sizes.append(np.diff(bounds))
                keys = ids[-1].tolist()
                for i in np.flatnonzero(np.diff(bounds) >= min_words).tolist():  # a shorter text has no passage
                    if keys[i] in known:  # a copy in the same pack
                        continue
                    known.add(keys[i])
                    s, p, back = seed_places(_short(hashes[bounds[i]:bounds[i + 1]]), min_words)
                    single = back < 0
                    seed.append(s[single])
                    place.append(p[single])
                    doc.append(np.full(int(single.sum()), docs + i))
                    n += len(seed[-1])
                docs += part.num_rows
                if n >= pack:
                    yield flush()
                    n = docs = 0
                    known.clear()
        if n:
            yield flush()

    return texts.select("key", "text").mapInArrow(
        run, "range int, seed long, seeds binary, docs binary, places binary, ids binary, sizes binary")


def _matched(group: pa.Table) -> pa.Table:
    """What occurs again in one hash range.

    Kind 0: a text's places with those of the first ones. Kind 1: the first place of a hot seed. Kind 2: a hot seed's other places, as they came.
    """
    join = lambda name, kind: np.frombuffer(b"".join(x for x in plain.column(name).to_pylist()), kind)
    hot = group.filter(pa.compute.is_valid(group.column("seed")))
    plain = group.filter(pa.compute.is_null(group.column("seed")))
    seed, place = join("seeds", "<u8"), join("places", "<u4")
    ids, sizes = join("ids", "<i8"), join("sizes", "<u4")
    docs = [np.frombuffer(x, "<u4").astype(np.int64) for x in plain.column("docs").to_pylist()]
    before = np.cumsum([0, *[len(x) // 8 for x in plain.column("ids").to_pylist()]])
    doc = np.concatenate([np.zeros(0, np.int64), *[d + b for d, b in zip(docs, before[:-1], strict=True)]])
    marked, place = place >> 31 == 1, (place & 0x7FFFFFFF).astype(np.int64)
    order = np.lexsort((place, ids[doc], sizes[doc], seed))
    seed, place, key, marked = seed[order], place[order], ids[doc][order], marked[order]
    begin = np.concatenate([[True], seed[1:] != seed[:-1]])[:len(seed)]
    first = np.flatnonzero(begin)[np.cumsum(begin) - 1] if len(seed) else np.zeros(0, np.int64)
    again = (key != key[first]) | (place != place[first])
    mine = np.flatnonzero(again)
    mine = mine[np.argsort(key[mine], kind="stable")]
    new = np.flatnonzero(np.concatenate([[True], key[mine][1:] != key[mine][:-1]])[:len(mine)])
    matches = pa.ListArray.from_arrays(pa.array(np.append(new, len(mine)).astype(np.int32)), pa.StructArray.from_arrays(
        [pa.array(key[first[mine]]), pa.array(place[first[mine]].astype(np.int32)), pa.array(place[mine].astype(np.int32))],
        names=["partner", "there", "here"]))
    firsts = np.unique(first[marked])
    n0, n1, n2 = len(new), len(firsts), hot.num_rows
    lists = lambda x, kind, to: pa.array([np.frombuffer(v, kind).astype(to) for v in x.to_pylist()], pa.list_(pa.from_numpy_dtype(to)))
    one = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(n1 + 1, dtype=np.int32)), pa.array(x, kind))
    return pa.table({
        "kind": pa.array(np.repeat([0, 1, 2], [n0, n1, n2]).astype(np.int32)),
        "key": pa.concat_arrays([pa.array(key[mine][new]), pa.nulls(n1 + n2, pa.int64())]),
        "matches": pa.concat_arrays([matches, pa.nulls(n1 + n2, matches.type)]),
        "seed": pa.concat_arrays([pa.nulls(n0, pa.int64()), pa.array(seed[firsts].view(np.int64)), pa.concat_arrays([pa.array([], pa.int64()), *hot.column("seed").chunks])]),
        "ids": pa.concat_arrays([pa.nulls(n0, pa.list_(pa.int64())), one(key[firsts], pa.int64()), lists(hot.column("ids"), "<i8", np.int64)]),
        "places": pa.concat_arrays([pa.nulls(n0, pa.list_(pa.int32())), one(place[firsts].astype(np.int32), pa.int32()), lists(hot.column("places"), "<u4", np.int32)]),
    })


def matched_places(texts: DataFrame, n_words: int, min_words: int = MIN_WORDS) -> DataFrame:
    """``key, matches`` (lists of lists) per text that has a place of a seed in common with another place; ``n_words`` sizes the ranges."""
    ranges = max(LEAST_RANGES, int(n_words * 0.6) // RANGE_SEEDS + 1)
    found = materialize(packed_seeds(texts, ranges, min_words).groupBy("range").applyInArrow(
        _matched, f"kind int, key long, matches {MATCHES}, seed long, ids array<long>, places array<int>"))
    first = found.where("kind = 1").select("seed", F.get("ids", F.lit(0)).alias("partner"), F.get("places", F.lit(0)).alias("there"))
    hot = found.where("kind = 2").join(first, "seed").select(
        "partner", "there", F.explode(F.arrays_zip("ids", "places")).alias("_p")).select(
        F.col("_p.ids").alias("key"), "partner", "there", F.col("_p.places").alias("here")).where("key <> partner OR here <> there")
    hot = hot.groupBy("key").agg(F.collect_list(F.struct("partner", "there", "here")).alias("matches"))
    return found.where("kind = 0").select("key", "matches").unionByName(hot).groupBy("key").agg(F.collect_list("matches").alias("matches"))


def word_table(texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``key, words``: the words of each class of ``key, text`` with ``min_words`` or more, copies combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, _, _, bounds = word_hashes(part.column(1))
                rows = np.flatnonzero(np.diff(bounds) >= min_words)
                words = [_short(hashes[bounds[i]:bounds[i + 1]]).tobytes() for i in rows]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(words, pa.binary())], names=["key", "words"])

    return texts.select("key", "text").mapInArrow(run, "key long, words binary").groupBy("key").agg(F.first("words").alias("words"))


def _chained(texts: DataFrame, reach: int, min_words: int = MIN_WORDS) -> DataFrame:
    """Chains of each text with the words around them, from rows ``key, words, matches, again``.

    ``again`` null: all chains; else the numbers of those to be cut out anew.
    """
    columns = ["key", "chain", "partner", "low", "more", "words", "here", "there", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, out = batch.column(2), []
            ends = np.concatenate([[0], np.cumsum([sum(len(x) for x in row) for row in lists])])
            flat = lists.flatten().flatten()
            partner, there, here = (flat.field(c).to_numpy().astype(np.int64) for c in ("partner", "there", "here"))
            for row, (key, packed, again) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True)):
                words, mine = np.frombuffer(packed, np.uint32), slice(ends[row], ends[row + 1])
                found = np.unique(np.stack([partner[mine], there[mine], here[mine]], axis=1), axis=0)
                # Steps of equal length begin with two places that match the same one or each other.
                if (found[:, 0] == key).any() or (found[1:, :2] == found[:-1, :2]).all(axis=1).any():
                    _, place, back = seed_places(words, min_words)
                    step = np.flatnonzero(back >= 0)
                    found = np.unique(np.concatenate([found, np.stack([np.full(len(step), key), back[step], place[step]], axis=1)]), axis=0)
                cuts = np.flatnonzero(np.concatenate([[True], found[1:, 0] != found[:-1, 0], [True]]))
                number = 0
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    x, y = found[a:b, 1], found[a:b, 2]
                    # Seeds that touch on one diagonal are one chain.
                    line = b - a == 1 or (np.diff(x) == np.diff(y)).all() and (np.diff(x) <= SEED).all()
                    for chain in [np.arange(b - a)] if line else chains(x.tolist(), y.tolist()):
                        number += 1
                        if again is not None and number not in again:
                            continue
                        low = max(0, int(y[chain[0]]) - reach)
                        high = min(len(words), int(y[chain[-1]]) + SEED + reach)
                        p, q, size = blocks(y[chain], x[chain], SEED)
                        out.append((key, number, int(found[a, 0]), low, len(words) - high, words[low:high].tobytes(), p, q, size))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int32())] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=columns)

    return texts.mapInArrow(
        run, "key long, chain int, partner long, low long, more long, words binary, here array<int>, there array<int>, size array<int>")


PASSAGE = ["start_word", "end_word", "partner_start", "partner_end", "matched_words"]


def _aligned(rows: DataFrame, reach: int) -> DataFrame:
    """Passages from chains joined with the partner's words ``theirs``; ``short`` where the words at hand came to an end before the texts did."""
    names = ["key", "chain", "partner", *PASSAGE, "short"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                theirs = np.frombuffer(row["theirs"], np.uint32)
                own = np.frombuffer(row["words"], np.uint32)
                low = max(0, row["there"][0] - reach)
                part = theirs[low:row["there"][-1] + row["size"][-1] + reach]
                more = len(theirs) - low - len(part)
                places = [(h - row["low"], t - low, n) for h, t, n in zip(row["here"], row["there"], row["size"], strict=True)]
                a, b, c, d, matched = align(own, part, places)
                # An edit needs AFTER_EDIT equal words behind it, so an end this close to the edge may not be the passage's.
                near = AFTER_EDIT + 1
                short = ((a <= near and row["low"] > 0) or (c <= near and low > 0)
                         or (b >= len(own) - near and row["more"] > 0) or (d >= len(part) - near and more > 0))
                out.append((row["key"], row["chain"], row["partner"], a + row["low"], b + row["low"], c + low, d + low, matched, short))
            if out:
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, "key long, chain int, partner long, " + ", ".join(f"{n} long" for n in PASSAGE) + ", short boolean")


def _passages(words: DataFrame, matches: DataFrame, min_words: int) -> DataFrame:
    """``key, partner`` and the passage of every chain, as long as the texts go on together."""
    theirs = words.select(F.col("key").alias("partner"), F.col("words").alias("theirs"))
    own = words.join(matches, "key").select("key", "words", "matches", F.lit(None).cast("array<int>").alias("again"))
    done, reach = [], REACH
    while True:
        # One job, so that both joins read one shuffle of the words.
        chained = _chained(own, reach, min_words)
        found = materialize(_aligned(chained.join(theirs, "partner").select(*chained.columns, "theirs"), reach))
        done.append(found.where("NOT short"))
        again = materialize(found.where("short").groupBy("key").agg(F.collect_list("chain").alias("again")))
        if again.isEmpty():
            return reduce(DataFrame.unionByName, done).select("key", "partner", *PASSAGE)
        own = words.join(matches.join(again, "key"), "key").select("key", "words", "matches", "again")
        reach *= MORE


def touching(found: list[dict]) -> list[list[dict]]:
    """Runs of passages that touch, from passages in the order of their first words."""
    groups: list[list[dict]] = []
    reach = -1
    for p in found:
        if not groups or p["start_word"] > reach:
            groups.append([])
            reach = -1
        groups[-1].append(p)
        reach = max(reach, p["end_word"])
    return groups


def counted(found: list[dict], min_words: int) -> list[dict]:
    """A text's passages that are long enough, and the fragments outside of them that are in a touching run of that length."""
    found = sorted(found, key=lambda p: (p["start_word"], p["end_word"], p["partner"]))
    keep = [p for p in found if p["matched_words"] >= min_words]
    covered = [(g[0]["start_word"], max(p["end_word"] for p in g)) for g in touching(keep)]
    rest, at = [], 0
    for p in found:
        if p["matched_words"] < min_words:
            while at < len(covered) and covered[at][1] < p["end_word"] and covered[at][1] <= p["start_word"]:
                at += 1
            if not any(a <= p["start_word"] and p["end_word"] <= b for a, b in covered[at:at + 1]):
                rest.append(p)
    for g in touching(rest):
        if max(p["end_word"] for p in g) - g[0]["start_word"] >= min_words:
            keep += g
    return keep


def _counted(passages: DataFrame, min_words: int) -> DataFrame:
    """Passages that are long enough alone or in a run of fragments that touch, by document."""
    by_doc = passages.groupBy("key").agg(F.collect_list(F.struct(*[c for c in passages.columns if c != "key"])).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [counted(found, min_words) for found in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keep, batch.schema.field(1).type)], names=["key", "found"])

    return by_doc.mapInArrow(run, by_doc.schema).select("key", F.explode("found").alias("_p")).select("key", "_p.*")


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Rows ``doc_id, partner_id, start_word, end_word, partner_start, partner_end, matched_words``.

    One row per passage of a class's first document and the partner that represents it; a copy of a text has one row that
    refers to the first. Word positions count from 0, ends are behind the last word.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.where(F.col(f"`{doc_id}`").isNotNull()).select(
        F.xxhash64(body).alias("key"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("text"))
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    members = materialize(rows.groupBy("key", "doc_id").agg(F.first(n_words).alias("n_words")).where(F.col("n_words") >= min_words))
    total = members.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    found = _counted(_passages(word_table(rows, min_words), matched_places(rows, total, min_words), min_words), min_words)
    first = members.groupBy("key").agg(F.min("doc_id").alias("first_id"))
    for c, k in (("doc_id", "key"), ("partner_id", "partner")):
        found = found.join(first.select(F.col("key").alias(k), F.col("first_id").alias(c)), k)
    zero, end = F.lit(0).cast("long"), F.col("n_words")
    copies = members.join(first, "key").where("doc_id <> first_id").select(
        "doc_id", F.col("first_id").alias("partner_id"), zero.alias("start_word"), end.alias("end_word"), zero.alias("partner_start"),
        end.alias("partner_end"), end.alias("matched_words"))
    return found.select("doc_id", "partner_id", *PASSAGE).unionByName(copies)

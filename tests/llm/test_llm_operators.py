"""Operators against brute force on small tables with nulls, empty and long texts, ties, copies and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from copycensus.llm import bpe, chaining, chat, decontaminate, language, near_dedup, quality, suffix_dedup, token_counts, warc
from copycensus.llm.components import components
from copycensus.llm.hashing import shingles, word_hashes
from copycensus.session import materialize

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def prose(rng: random.Random, n: int, letters: str = "abcdefghij") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Odd texts, copies, near copies and shared passages; repeated rows; extra columns named like results."""
    rng = random.Random(5)
    base = prose(rng, 300)
    passage = prose(rng, 90)
    texts = [None, "", " \n\t ", "one", "Two words", "a b c d", "a b c d", "ünï ß 日本語 🙂   x", "#$%& <|x|> " * 30, "x" * 3000,
             "same line here now\n" * 80, base, base, base.upper(), prose(rng, 20_000)]
    for cut in (3, 10, 30, 60):
        words = base.split()
        for at in rng.sample(range(300), cut // 3):
            words[at] = "new" + words[at]
        texts.append(" ".join(words))
    texts += [prose(rng, 50) + " " + passage + "\n" + prose(rng, 70) for _ in range(4)]
    texts += [prose(rng, rng.randint(5, 200)) for _ in range(20)]
    rows = [(i, t, "xx", "s", None if t is None else len(t), "clash", 7) for i, t in enumerate(texts)]
    rows += [rows[11], rows[1], (None, base, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int").repartition(3).cache()


@pytest.fixture(scope="module")
def texts(corpus):
    return [(r["doc_id"], r["text"] or "") for r in corpus.collect()]


def empty(corpus):
    return corpus.where("false")


def test_word_hashes_are_those_of_words(texts):
    hashes, start, end, bounds = word_hashes(pa.array([t for _, t in texts]))
    known: dict[str, int] = {}
    for i, (_, t) in enumerate(texts):
        found = [w.translate(LOWER) for w in WORD.findall(t)]
        assert bounds[i + 1] - bounds[i] == len(found)
        for w, h in zip(found, hashes[bounds[i]:bounds[i + 1]].tolist(), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    assert len(shingles(hashes[:3], 5)) == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, None, ""), (3, "http://x/ \r\ny", "same"), (9, "u", "same"), (4, "u", None), (7, None, "é" * 700_000),
            (8, "u", "WARC/1.1\r\n\r\n\r\n"), (8, "u", "WARC/1.1\r\n\r\n\r\n"), (None, "u", "lone"), (2, "u", "last\r\n")]
    pages = spark.createDataFrame([(*r, 1, b"x") for r in rows], "page_id long, url string, html string, chunk_no int, data binary")
    chunks = warc.round_trip(pages, chunk=1000).cache()
    found = sorted((tuple(r) for r in warc.checked_records(chunks).collect()), key=str)
    first = {}
    for i, _, p in rows:
        first[p or ""] = min((x for x in (first.get(p or ""), i) if x is not None), default=None)
    expected = []
    for i, _, p in rows:
        data, least = (p or "").encode(), first[p or ""]
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                         "response" if i == least else "revisit", None if i == least else least))
    assert found == sorted(expected, key=str)
    assert chunks.agg(F.max(F.length("data"))).first()[0] <= 1000
    whole = [r["data"] for r in chunks.where("record_id = 7").orderBy("chunk_no").collect()]
    assert b"".join(whole).decode() == "é" * 700_000
    assert warc.checked_records(warc.round_trip(pages.where("false"))).count() == 0
    least = {r["record_id"]: r["record_type"] for r in warc.checked_records(warc.round_trip(pages, least_bytes=10)).collect()}
    assert set(least.values()) == {"response"}


def test_warc_folder_without_a_scheme_on_a_cluster(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "a b%20c")  # as in Spark's paths, blanks and percent signs stand for themselves
    monkeypatch.setattr(warc, "shared_dir", lambda _: folder)
    monkeypatch.setattr("copycensus.session.shared_dir", lambda _: folder)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    pages = spark.createDataFrame([(2, "u", "same"), (1, "u", "same"), (3, "u", None)], "page_id long, url string, html string")
    found = warc.checked_records(warc.round_trip(pages)).select("record_id", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found)) == [(1, "response", None), (2, "revisit", 1), (3, "response", None)]
    assert list((tmp_path / "a b%20c").glob("warc-*/*.warc.gz"))
    with pytest.raises(FileNotFoundError, match="every executor"):
        warc.shared(f"file:{tmp_path}/elsewhere")


def test_warc_keeps_bytes_that_are_no_utf8(spark):
    rows = [(1, b"http://x/\xff", b"ab\xff\xfecd"), (2, b"u", b"\xed\xa0\x80")]
    pages = spark.createDataFrame(rows, "page_id long, url binary, html binary").select(
        "page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    chunks = warc.round_trip(pages).cache()
    assert {r["record_id"]: bytes(r["data"]) for r in chunks.collect()} == {i: data for i, _, data in rows}
    assert sorted(tuple(r)[:3] for r in warc.checked_records(chunks).collect()) == [
        (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode()) for i, _, data in rows]
    assert chunks.where("record_id = 1").first()["url"] == "http://x/%FF"


def brute_items(texts, items):
    """Best weighted shingle similarity of each item with the windows of its length."""
    cut = lambda w: [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]
    words = lambda t: [w.translate(LOWER) for w in WORD.findall(t)]
    out = {}
    for d, t in texts:
        w = words(t)
        for i, x in items:
            v = words(x or "")
            if not v or not w:
                continue
            own = Counter(cut(v)) if len(v) >= 5 else Counter([tuple(v)])
            for s in range(max(1, len(w) - len(v) + 1)):
                window = w[s:s + len(v)]
                theirs = Counter(cut(window)) if len(v) >= 5 else Counter([tuple(window)] if len(window) == len(v) else [])
                shared = sum((own & theirs).values())
                score = shared / (sum(own.values()) + sum(theirs.values()) - shared)
                if score >= 0.75:
                    out[d, i] = max(score, out.get((d, i), 0))
    return out


def test_decontamination_finds_what_brute_force_finds(spark, corpus):
    rng = random.Random(8)
    items = [(i, prose(rng, n)) for i, n in enumerate([1, 3, 5, 14, 20, 33, 47, 59, 80, 300])] + [(20, None), (21, " "), (3, None)]
    planted = []
    for k in range(60):
        words = rng.choice(items[3:10])[1].split()
        if len(words) > 45 and k % 2:
            words[len(words) // 2] = "edit"
        if k % 5 == 0:
            words = words[:-2]
        planted.append((1000 + k, prose(rng, rng.randint(0, 150)) + " " + " ".join(words) + " " + prose(rng, rng.randint(0, 90)), None))
    docs = spark.createDataFrame([*planted, (1, None, None), (2, "", None), (3, items[4][1].upper(), None), (None, items[5][1], None)],
                                 "doc_id long, text string, item_id string")
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(
        docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    expected = brute_items([(r["doc_id"], r["text"] or "") for r in docs.collect()], items)
    missed = {k: v for k, v in expected.items() if k not in found}
    assert not [k for k, v in missed.items() if v > 0.85] and len(missed) <= len(expected) // 50
    assert set(found) <= set(expected) and all(abs(found[k] - expected[k]) < 1e-9 for k in found)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, nothing).count() == 0
    assert decontaminate.contaminated(docs.where("false"), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    clean = decontaminate.decontaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in found if d is not None}


def test_multi_index_finds_every_print_in_radius():
    rng = np.random.default_rng(3)
    items = rng.integers(0, 1 << 63, (40, 2)).astype(np.uint64)
    queries = []
    for i in range(400):
        bits = np.unpackbits(items[i % 40].view(np.uint8))
        bits[rng.choice(128, rng.integers(0, 45), replace=False)] ^= 1
        queries.append(np.packbits(bits).view(np.uint64))
    queries = np.stack(queries)
    window, item, distance = decontaminate.Index(items).search(queries)
    near = np.bitwise_count(queries[:, None] ^ items[None]).sum(axis=2)
    assert set(zip(window.tolist(), item.tolist(), strict=True)) == set(zip(*map(list, np.nonzero(near <= decontaminate.RADIUS)), strict=True))
    assert (near[window, item] == distance).all()


def test_chains_are_best_and_disjoint():
    rng = random.Random(2)
    x, y = [rng.randrange(60) for _ in range(40)], [rng.randrange(60) for _ in range(40)]
    found = chaining.chains(x, y)
    assert sorted(i for c in found for i in c) == list(range(40))
    best = [0.0] * 40
    for i in sorted(range(40), key=lambda i: (x[i], y[i])):
        best[i] = 1 + max([0, *(best[j] - chaining.GAP_COST * (x[i] - x[j] + y[i] - y[j]) for j in range(40) if x[j] < x[i] and y[j] < y[i])])
    score = lambda c: len(c) - chaining.GAP_COST * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]])
    assert abs(score(found[0]) - max(best)) < 1e-9
    assert all(x[a] < x[b] and y[a] < y[b] for c in found for a, b in zip(c, c[1:], strict=False))


def test_chained_passages(spark, corpus):
    rng = random.Random(4)
    passage = prose(rng, 120).split()
    fuzzy = list(passage)
    fuzzy[50] = "other"
    del fuzzy[90]
    docs = [(1, prose(rng, 80) + " " + " ".join(passage)), (2, prose(rng, 40) + " " + " ".join(fuzzy) + " " + prose(rng, 100)),
            (3, prose(rng, 500)), (4, prose(rng, 60)), (5, None), (6, ""), (7, " ".join(passage[:30])), (8, prose(rng, 60))]
    docs.append((9, docs[3][1]))
    rows = chaining.passages(spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, partner string")).collect()
    assert {(r["doc_id"], r["partner_id"]) for r in rows} == {(1, 2), (9, 4)} or {(r["doc_id"], r["partner_id"]) for r in rows} == {(2, 1), (9, 4)}
    hit = next(r for r in rows if r["doc_id"] != 9)
    low, high = (hit["start_word"], hit["end_word"]) if hit["doc_id"] == 1 else (hit["partner_start"], hit["partner_end"])
    assert (low, high) == (80, 200) and hit["matched_words"] == 118
    assert chaining.passages(empty(corpus)).count() == 0
    chaining.passages(corpus).count()


def test_chained_passages_hold_every_long_exact_repeat(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    flagged = {x for r in chaining.passages(docs).collect() for x in (r["doc_id"], r["partner_id"])}
    rows = docs.select("doc_id", "text").collect()
    owners = defaultdict(set)
    for r in rows:
        w = [x.translate(LOWER) for x in WORD.findall(r["text"] or "")]
        for i in range(len(w) - 50):
            if len(set(w[i:i + 51])) > 10:  # runs of a few words over and over are no passage
                owners[tuple(w[i:i + 51])].add(r["doc_id"])
    planted = set().union(*(v for v in owners.values() if len(v) > 1))
    assert planted and planted <= flagged


def test_passages_have_all_places_and_repeats_within_a_text(spark):
    rng = random.Random(14)
    shared, own, line = prose(rng, 80), prose(rng, 70), prose(rng, 12)
    docs = [(1, prose(rng, 100) + " " + own + " " + prose(rng, 60) + " " + own), (2, shared + " " + prose(rng, 150)),
            (3, prose(rng, 300) + " " + shared + " " + prose(rng, 90) + " " + shared), (4, prose(rng, 30) + " " + " ".join([line] * 300)),
            (5, " ".join(["word"] * 5000))]
    rows = chaining.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = sorted((r["doc_id"], r["start_word"], r["end_word"], r["partner_id"], r["partner_start"]) for r in rows)
    expected = {(1, 230, 300, 1, 100), (3, 300, 380, 2, 0), (3, 470, 550, 2, 0), (4, 42, 3630, 4, 30), (5, 1, 5000, 5, 0)}
    # Seeds at a passage's edge may have their first place in its second copy: one more row for the third.
    assert expected <= set(found) <= expected | {(3, 470, 550, 3, 300)}
    assert all(r["matched_words"] == r["end_word"] - r["start_word"] for r in rows)


def test_fuzzy_passages_are_found(spark):
    """Copies of 50 to 120 words, an edit every 12 to 20: words replaced at equal steps, or replaced, left out and put in at random places."""
    rng = random.Random(21)
    docs, kinds = [], {}
    for k in range(600):
        n, step, even = rng.choice([50, 60, 80, 120]), rng.choice([12, 15, 20]), k % 2 == 0
        words = prose(rng, n).split()
        edited = list(words)
        for at in range(step - 1, n, step) if even else sorted(rng.sample(range(n), n // step), reverse=True):
            edit = 0 if even else rng.randrange(3)
            edited[at:at + 1] = [["edit"], [], [edited[at], "more"]][edit]
        for d, w in ((2 * k, words), (2 * k + 1, edited)):
            docs.append((d, " ".join([prose(rng, rng.randint(5, 90)), *w, prose(rng, rng.randint(5, 90))])))
        kinds[k] = even
    pairs = {frozenset((r["doc_id"], r["partner_id"])) for r in chaining.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = Counter(even for k, even in kinds.items() if frozenset((2 * k, 2 * k + 1)) in pairs)
    print(f"found {found[True]} of 300 with edits at equal steps, {found[False]} of 300 with edits at random places")
    assert found[True] == 300 and found[False] >= 297


def test_fragments_beside_a_passage_count_by_their_own_span():
    piece = lambda a, b, partner: {"start_word": a, "end_word": b, "partner": partner, "matched_words": b - a}
    spans = lambda *p: sorted((x["start_word"], x["end_word"]) for x in chaining.counted([piece(a, b, i) for i, (a, b) in enumerate(p)], 40))
    assert spans((0, 45), (45, 80), (80, 115)) == [(0, 45), (45, 80), (80, 115)]
    assert spans((0, 35), (35, 70), (60, 105)) == [(0, 35), (35, 70), (60, 105)]
    assert spans((0, 45), (45, 80)) == [(0, 45)]
    assert spans((0, 100), (20, 50), (45, 80)) == [(0, 100)]
    assert spans((0, 30), (31, 60)) == []
    assert spans((0, 30), (21, 60)) == [(0, 30), (21, 60)]


def test_quotes_do_not_part_two_passages(spark):
    """Texts that quote less than a passage, alone or among other words, come before two longer texts that share all of it."""
    rng = random.Random(31)
    docs, cases = [], range(400)
    for k in cases:
        n, quote = rng.choice([(52, 38), (50, 39), (48, 39), (47, 39)])
        words = prose(rng, n).split()
        at = rng.randint(0, n - quote)
        # One quote, or two that hold all of the passage's short runs between them; in texts below or above MIN_WORDS words.
        for j, part in enumerate([words[at:at + quote]] if k % 4 < 2 else [words[:quote], words[-quote:]]):
            docs.append((5 * k + 3 + j, " ".join(part if k % 2 else [prose(rng, 3), *part, prose(rng, 2)])))
        docs += [(5 * k + j, " ".join([prose(rng, rng.randint(20, 60)), *words, prose(rng, rng.randint(20, 60))])) for j in (1, 2)]
    rows = chaining.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    pairs = {frozenset((r["doc_id"], r["partner_id"])) for r in rows if r["matched_words"] >= chaining.MIN_WORDS}
    found = sum(frozenset((5 * k + 1, 5 * k + 2)) in pairs for k in cases)
    print(f"found {found} of {len(cases)} pairs beside quotes")
    assert found == len(cases)


def test_passages_go_on_until_the_texts_differ(spark):
    rng = random.Random(71)
    words = prose(rng, 2000).split()
    docs = [(1, prose(rng, 30) + " " + " ".join(words)), (2, prose(rng, 20) + " " + " ".join(words) + " " + prose(rng, 900)), (3, " ".join(words[1000:]))]
    rows = {(r["doc_id"], r["partner_id"]): tuple(r)[2:] for r in chaining.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows == {(2, 1): (20, 2020, 30, 2030, 2000), (1, 3): (1030, 2030, 0, 1000, 1000), (2, 3): (1020, 2020, 0, 1000, 1000)}


def test_passages_of_repeated_rows_and_of_one_id_with_two_texts(spark):
    rng = random.Random(72)
    shared, first, second = prose(rng, 100), prose(rng, 60), prose(rng, 90)
    one, two = first + " " + shared, shared + " " + second
    schema = "doc_id long, text string"
    expected = {(2, 1, 0, 100, 60, 160, 100)}
    for docs in ([(1, one), (2, two)], [(1, one), (1, one), (2, two), (2, two), (None, one)]):
        rows = chaining.passages(spark.createDataFrame(docs, schema)).collect()
        assert len(rows) == 1 and set(map(tuple, rows)) == expected
    rows = chaining.passages(spark.createDataFrame([(1, one), (1, two), (1, one), (3, one), (4, prose(rng, 50))], schema)).collect()
    assert sorted(map(tuple, rows)) == [(1, 1, 0, 100, 60, 160, 100), (3, 1, 0, 160, 0, 160, 160)]


def test_hot_seeds_are_dealt_out_without_loss(spark, monkeypatch):
    """Small packs, many ranges and a seed that is hot from two places on give the rows of one range."""
    rng = random.Random(73)
    line, passage = prose(rng, 45), prose(rng, 90)
    docs = [(i, prose(rng, rng.randint(5, 60)) + " " + (passage if i % 3 else line) + " " + prose(rng, 30) + (" " + line if i % 5 == 0 else "")) for i in range(120)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    whole = sorted(map(tuple, chaining.passages(table).collect()))
    for name, value in (("PACK_SEEDS", 500), ("RANGE_SEEDS", 300), ("HOT_PLACES", 2)):
        monkeypatch.setattr(chaining, name, value)
    assert sorted(map(tuple, chaining.passages(table).collect())) == whole and len(whole) >= 119


@pytest.mark.parametrize("rule", ["first", "most"])
def test_section_tokens(spark, corpus, rule):
    rows = token_counts.count_sections(corpus, rule=rule).collect()
    own, _ = token_counts.encoding(public_tokenizers.path(token_counts.VOCABULARY))
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    copies = Counter(r["doc_id"] for r in corpus.collect())
    for r in corpus.collect():
        text, mine = r["text"] or "", by_doc[r["doc_id"]]
        n = len(own.encode_ordinary(text))
        assert sum(x["n_tokens"] for x in mine) == n * copies[r["doc_id"]] and {x["doc_tokens"] for x in mine} == {n}
        spans = sorted({(x["start_char"], x["end_char"]) for x in mine})
        assert "".join(text[a:b] for a, b in spans) == text
    assert token_counts.count_sections(empty(corpus)).count() == 0


def test_token_attribution_against_brute_force():
    text = "Héllo wörld\n\n  日本語🙂 don't  stop\n\nx" * 5
    starts, ends = token_counts.token_spans(text, public_tokenizers.path(token_counts.VOCABULARY))
    spans = np.array([(0, 8), (8, 15), (15, 15), (15, 40), (60, 90), (90, 10_000)])
    counts, crossed = token_counts.attribute(starts, ends, spans, "first")
    assert counts.tolist() == [int(((starts >= a) & (starts < b)).sum()) for a, b in spans]
    most, _ = token_counts.attribute(starts, ends, spans, "most")
    expected = np.zeros(len(spans), int)
    for a, b in zip(starts, ends, strict=True):
        shared = [max(0, min(b, e) - max(a, s)) for s, e in spans]
        if max(shared):
            expected[int(np.argmax(shared))] += 1
    assert most.tolist() == expected.tolist()


def brute_near(texts):
    cut = lambda w: frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    sets = [(d, cut([w.translate(LOWER) for w in WORD.findall(t)])) for d, t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, a) in enumerate(sets):
        for j in range(i):
            e, b = sets[j]
            if a and b and d is not None and e is not None and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return sorted(((d, len(s), least[find(i)], d == least[find(i)]) for i, (d, s) in enumerate(sets)), key=str)


def test_near_duplicates_match_brute_force(spark, corpus, texts):
    found = near_dedup.near_duplicates(corpus).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, found), key=str) == brute_near(texts)
    assert near_dedup.near_duplicates(empty(corpus)).count() == 0


def test_repeated_rows_through_near_dedup_and_suffix_dedup(spark):
    rng = random.Random(51)
    a, b, c, d = (prose(rng, 200) for _ in range(4))
    docs = spark.createDataFrame(
        [(1, a, "x"), (1, a, "x"), (2, a, "y"), (None, b, "x"), (None, b, "x"), (None, c, "x"), (4, c, "z"), (5, d, "x"), (6, "", "x"), (7, "", "x"), (8, None, "x"),
         (None, None, "x")], "doc_id long, text string, source string").repartition(3)
    once = near_dedup.deduplicated(docs).cache()
    rows = [(1, a), (None, b), (4, c), (5, d), (6, ""), (7, ""), (8, None), (None, None)]
    assert once.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in once.collect()), key=str) == sorted(rows, key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in suffix_dedup.without_repeats(once).collect()), key=str) == sorted(rows, key=str)


def test_near_dedup_shuffles_the_rows_once(spark, corpus):
    """After the links are known, whole rows go through one shuffle; everything else is settled on digests."""
    query = near_dedup.deduplicated(materialize(corpus))._jdf.queryExecution()
    plan = query.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    sent = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", plan)
    assert len(sent) > 3 and sum(bool(re.search(r"\b(row|text)#", x)) for x in sent) == 1


def test_near_dedup_keeps_repeated_rows_without_words(spark):
    docs = spark.createDataFrame([(1, " "), (1, " "), (2, None), (2, None), (None, ""), (None, ""), (3, "a b"), (3, "a b"), (4, "a b")], "doc_id long, text string")
    found = [tuple(r) for r in near_dedup.deduplicated(docs).collect()]
    assert sorted(found, key=str) == sorted([(1, " "), (1, " "), (2, None), (2, None), (None, ""), (None, ""), (3, "a b")], key=str)


@pytest.mark.parametrize("percent", [50, 74, 101])
def test_near_duplicates_refuse_what_the_sketches_miss(corpus, percent):
    for run in (near_dedup.near_duplicates, near_dedup.deduplicated):
        with pytest.raises(ValueError, match="percent"):
            run(corpus, percent=percent)


@pytest.mark.parametrize("block", [None, 4000])
def test_near_copies_of_one_text(spark, monkeypatch, block):
    """A large group of near copies, also cut into blocks that are compared in pairs, and without the bit tables."""
    if block:
        monkeypatch.setattr(near_dedup, "BLOCK_BYTES", block)
    rng = random.Random(11)
    base = prose(rng, 200).split()
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(200), rng.randint(0, 16)):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, found), key=str) == brute_near(rows)


def test_linked_pairs_without_bit_tables(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(300) < 0.12 * rng.random(), rng.integers(0, 1 << 62, 300).astype(np.uint64), base)) for _ in range(40)]
    with_bits = near_dedup.linked_pairs(sets, np.ones(40, bool), 75)
    monkeypatch.setattr(near_dedup, "BIT_BYTES", 0)
    assert sorted(map(tuple, with_bits)) == sorted(map(tuple, near_dedup.linked_pairs(sets, np.ones(40, bool), 75)))


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(30)] + [(5, 5), (None, 3)]
    found = {r["node"]: r["component_id"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for p in links for x in p if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    linked = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert found == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_statistics(corpus):
    for r in quality.judge(corpus).collect():
        text = r["text"] or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        often = Counter(windows)
        covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 8)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), sum(text.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert r["kept"] == (r["rejected_by"] is None) and not (r["kept"] and r["base_failed"])


def test_quality_order_does_not_change_verdicts(corpus):
    rules = quality.default_rules()
    rows = quality.with_statistics(corpus).withColumns({"text": F.col("row.text"), "doc_id": F.col("row.doc_id")})
    one = rows.select("doc_id", quality.cascade(rules).isNull().alias("kept")).collect()
    other = rows.select("doc_id", quality.cascade(rules[::-1]).isNull().alias("kept")).collect()
    assert sorted(map(str, one)) == sorted(map(str, other))
    assert quality.judge(empty(corpus)).count() == 0
    assert {r.name for r in quality.order_rules(corpus, "text", rules)} == {r.name for r in rules}


def test_byte_bpe_is_tiktoken(corpus, texts):
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode_documents(corpus).collect():
        assert r["token_ids"] == own.encode_ordinary(r["text"] or "") and bytes(r["decoded"]).decode() == (r["text"] or "")
    digests = sorted((tuple(r) for r in bpe.digest_documents(corpus).collect()), key=str)
    expected = []
    for d, t in texts:
        ids = own.encode_ordinary(t)
        expected.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert digests == sorted(expected, key=str)
    assert bpe.digest_documents(empty(corpus)).count() == 0


def test_every_piece_encodes_to_itself():
    own = bpe.codec(public_tokenizers.path(bpe.VOCABULARY))
    mapped = [p.decode("latin-1").translate(own.to_char) for p in own.pieces]
    assert [list(x) for x in own.model.encode(mapped, num_threads=1)] == [[i] for i in range(len(mapped))]


def covered(texts, length):
    """Per text a mask of the bytes in a string of that length that occurs elsewhere too."""
    seen = Counter(t.encode()[i:i + length] for _, t in texts for i in range(len(t.encode()) - length + 1))
    out = []
    for _, t in texts:
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if seen[data[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append((gone, int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())))
    return out


def brute_repeats(texts, length=suffix_dedup.LENGTH, passage=suffix_dedup.PASSAGE):
    out = []
    for (d, t), (gone, spans), (short, passages) in zip(texts, covered(texts, length), covered(texts, passage), strict=True):
        data = t.encode()
        kept = hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()
        out.append((d, len(data), int(gone.sum()), spans, kept, int(short.sum()), passages))
    return sorted(out, key=str)


@pytest.mark.parametrize("salted", [False, True])
def test_suffix_dedup_matches_brute_force(corpus, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", 3)
        monkeypatch.setattr(suffix_dedup, "SALT_SEGMENTS", 2)
    small = corpus.where("coalesce(length(text), 0) < 20000")
    texts = [(r["doc_id"], r["text"] or "") for r in small.collect()]
    assert sorted((tuple(r) for r in suffix_dedup.digests(small).collect()), key=str) == brute_repeats(texts)


def test_suffix_dedup_cuts_segments_once_per_text(spark, monkeypatch):
    rng = random.Random(41)
    base = prose(rng, 300)
    rows = [(i, base) for i in range(500)] + [(500, prose(rng, 40) + " " + base[:900] + " " + prose(rng, 40)), (500, base)]
    cut, seen = suffix_dedup._segments, []

    def counted(texts, shape):
        seen.append(cut(texts, shape))
        return seen[-1]

    monkeypatch.setattr(suffix_dedup, "_segments", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup.digests(docs).collect())
    assert found == sorted((d, len(base) if t == base else 900) for d, t in rows)
    made = seen[0].groupBy("a", "b", "place").count().collect()
    assert len({(r["a"], r["b"]) for r in made}) == 2 and {r["count"] for r in made} == {1}


def test_suffix_dedup_keeps_characters_whole(spark, corpus):
    rng = random.Random(3)
    shared = "".join(rng.choice("éüß日") for _ in range(300))
    docs = spark.createDataFrame([(1, "日" + shared + "é"), (2, "ü" + shared + "x"), (3, None), (4, "short")], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(docs).collect()}
    assert kept[3] is None and kept[4] == "short" and len(kept[1]) <= 4 and len(kept[2]) <= 4
    assert suffix_dedup.digests(empty(corpus)).count() == 0


@pytest.mark.parametrize("length", [100, 200, 400])
def test_length_of_repeats_is_a_parameter(spark, length):
    rng = random.Random(length)
    shared = {n: "".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (99, 100, 199, 200, 399, 400)}
    texts = [(i, prose(rng, 30) + "\x01" + s + "\x02" + prose(rng, 30)) for i, s in enumerate([*shared.values(), *shared.values()])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = sorted((r["doc_id"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.digests(docs, length=length, passage=None).collect())
    assert found == [(d, int(g.sum()), n) for (d, _), (g, n) in zip(texts, covered(texts, length), strict=True)]
    left = {r["doc_id"]: len(r["text"]) for r in suffix_dedup.without_repeats(docs, length=length).collect()}
    assert left == {d: len(t) - int(g.sum()) for (d, t), (g, _) in zip(texts, covered(texts, length), strict=True)}
    with pytest.raises(ValueError, match="Lengths"):
        suffix_dedup.digests(docs, length=100, passage=200)


def test_column_sort_against_plain_comparison():
    rng = np.random.default_rng(6)
    segments = rng.integers(97, 99, (60, 40)).astype(np.uint8)
    segments[5], segments[9, 10:], segments[30, 35:] = segments[4], segments[8, 10:], 0xFF
    repeated, first = suffix_dedup.repeated_columns(segments, (5, 12), last_start=20)
    for n, k, at in [(n, k, at) for k, n in enumerate((5, 12)) for at in range(21)]:
        strings = [segments[i, at:at + n].tobytes() if not (segments[i, at:at + n] == 0xFF).any() else (i,) for i in range(60)]
        often = Counter(strings)
        assert repeated[k][:, at].tolist() == [often[s] > 1 for s in strings]
        assert sorted(s for s, f in zip(strings, first[k][:, at], strict=True) if f and often[s] > 1) == sorted({s for s in strings if often[s] > 1})


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    rows = language.predict(docs, model).where(language.held_out(F.col("doc_id"))).where("length(text) > 60").collect()
    assert len(rows) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_texts(spark, corpus):
    rows = corpus.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").when(F.col("doc_id") % 3 == 0, "bb")).withColumn("score", F.lit("clash"))
    model = language.fit(rows)
    assert set(model.languages) == {"aa", "bb"}
    found = language.predict(rows, model).collect()
    assert len(found) == rows.count()
    for r in found:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in ("aa", "bb")
    nothing = language.fit(empty(rows))
    assert {r["lang_pred"] for r in language.predict(rows, nothing).collect()} == {"und"}
    assert language.predict(empty(rows), model).count() == 0


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<|turn|>user\n<|end|>\n", "\\<|image:0|>\\\\", "", None, "<<SYS>> [/SYS] <s>", "é🙂\\n\n", "<\\|x|>"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant"] * 4, odd, strict=True))]
    rows += [(2, 0, None, "a"), (2, None, "weird\nrole <|turn|>", "b"), (2, 0, None, "a"), (None, 1, "assistant", "c"), (3, 5, "assistant", None)]
    rows += [(4, i, "assistant" if i % 2 else "user", f"t{i} \\ <|end|>") for i in range(500)]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_conversations(turns.withColumn("parts", chat.text_parts(F.col("text"))))
    found = {r["conv_id"]: r for r in done.select(
        "conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss"), "formatted", "loss").collect()}
    assert set(found) == {1, 2, 3, 4, None}
    for c, r in found.items():
        mine = sorted([x for x in rows if x[0] == c], key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in mine]
        assert r[2] == "".join(x[3] or "" for x in mine if x[2] == "assistant")
    for s in found[4][4]:
        assert found[4]["formatted"][s["start"]:s["start"] + s["length"]].startswith("t")
    assert chat.format_conversations(turns.where("false").withColumn("parts", chat.text_parts(F.col("text")))).count() == 0


def test_chat_parts(spark):
    part = lambda **k: {n: k.get(n) for n in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    rows = [(1, 0, "user", [part(type="text", text="see "), part(type="image", ref="i1", width=57, height=28), part(type="audio", ref="a", seconds=2.0),
                            part(type="text", text=" <|image:0|>"), part(type="image", ref="i2")]),
            (1, 1, "assistant", [part(type="document", ref="d", pages=3), part(text="fine"), part(type="other", text="!")]), (2, 0, "user", None)]
    done = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(
        rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).withColumn(
        "turns", chat.read_turns(F.col("formatted"))).collect()}
    assert done[1]["turns"][0]["body"] == "see <|image:0|><|audio:1|> <\\|image:0|><|image:2|>"
    assert [(a["turn"], a["ordinal"], a["kind"], a["ref"], a["tokens"]) for a in done[1]["attachments"]] == [
        (1, 0, "image", "i1", 3), (1, 1, "audio", "a", 50), (1, 2, "image", "i2", 1), (2, 0, "document", "d", 3072)]
    assert done[1]["attachment_tokens"] == 3126 and done[1]["turns"][1]["text"] == "fine!"
    assert done[2]["turns"][0]["text"] == "" and done[2]["attachment_tokens"] == 0


CLASHING = ["a", "b", "_a", "_b", "_ranges", "_gone", "_words", "_text", "row", "x.y", "gone", "h", "kept", "id", "body", "n_words"]


def test_columns_of_any_name_pass_through_every_stage(spark):
    """Values, types and order of the caller's columns stay, whatever the operators call their own."""
    import corpus_pipeline

    rng = random.Random(9)
    shared = prose(rng, 80)
    texts = [prose(rng, 120), prose(rng, 40) + " " + shared, shared + " " + prose(rng, 40), prose(rng, 60), None, ""]
    texts.append(texts[0])
    extra = {c: f"value of {c}" for c in CLASHING}
    rows = [(i, t, "xx", "s", len(t or ""), *[f"{v} {i}" for v in extra.values()]) for i, t in enumerate(texts)]
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))
    for stage in (near_dedup.deduplicated, suffix_dedup.without_repeats):
        kept = stage(docs)
        assert kept.columns == names
        for r in kept.collect():
            assert tuple(r)[5:] == rows[r["doc_id"]][5:]
    judged = quality.judge(docs)
    for r in judged.collect():
        assert r["x.y"] == rows[r["doc_id"]][names.index("x.y")] and r["_words"] == f"value of _words {r['doc_id']}" and isinstance(r["kept"], bool)
    for table in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == names, name
            for r in out.collect():
                assert tuple(r)[5:] == rows[r["doc_id"]][5:], name
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() == table.count()


def test_rule_order_is_stable(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    orders = {tuple(r.name for r in quality.order_rules(docs, "text", quality.default_rules())) for _ in range(3)}
    assert {o[0] for o in orders} == {"symbols"} and {o[-1] for o in orders} == {"word_length"}

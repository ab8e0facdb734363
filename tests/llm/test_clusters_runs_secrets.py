"""Clustering, periodic runs and secret scans against brute force, with nulls, ties, copies, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import sys
from fractions import Fraction
from pathlib import Path
from zlib import crc32

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from copycensus.llm import clustering, periodic, secrets  # noqa: E402
from copycensus.llm.queries import REGISTRY  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Centroid clustering


def brute_clusters(rows, k=16, rounds=3, dims=64):
    rows = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    centers = [v for _, v in starts]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers)) for _, v in rows]

    for _ in range(rounds):
        own = assign()
        for n in range(len(centers)):
            mine = [v for (_, v), (_, m) in zip(rows, own, strict=True) if m == n]
            if mine:
                centers[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = assign()
    total = sum(d for d, _ in own)
    by = [sum(d for d, m in own if m == n) for n in range(len(centers))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, n, d, by[n], total, digest[n]) for (i, _), (d, n) in zip(rows, own, strict=True)), key=str)


@pytest.mark.parametrize("n", [0, 3, 90])
def test_clusters_match_brute_force(spark, n):
    rng = random.Random(n)
    centers = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(7)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centers)], 1, "z") for i in range(n)]
    if n > 3:
        rows += [rows[0], (7, rows[9][1], 2, "z"), (None, rows[5][1], 0, None), (1000, None, 0, None), (1001, [1.0] * 63, 0, None),
                 (1002, [float("nan")] * 64, 0, None), (1003, [float("inf")] * 64, 0, None), (1004, [None] + [0.5] * 63, 0, None), (1005, [], 0, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int, components string").repartition(3)
    found = clustering.summarised(table)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_clusters([(i, v) for i, v, _, _ in rows])


def test_components_beyond_64_bits_are_left_out(spark):
    table = spark.createDataFrame([(1, [3e38] * 64), (2, [0.25] * 64)], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in clustering.summarised(table).collect()] == [2]


def test_bounds_are_never_above_the_distances_and_leave_out_most():
    rng = np.random.default_rng(4)
    centers = rng.integers(-(1 << 20), 1 << 20, (16, 64))
    x = (centers[rng.integers(0, 16, 3000)] + rng.integers(-40_000, 40_000, (3000, 64))).astype(np.int64)
    now = centers + rng.integers(-9_000, 9_000, centers.shape)
    far = clustering.squared(x[:, None], centers[None])
    true = clustering.squared(x[:, None], now[None])
    assert (clustering.lower_bounds(far, now, centers) <= true).all()
    own, distance, measured = clustering.nearest(x, far, now, centers)
    assert (own == np.argmin(true, axis=1)).all() and (distance == true.min(axis=1)).all() and measured.mean() < 2


def test_equal_distances_go_to_the_smaller_number():
    x = np.zeros((2, 4), np.int64)
    centers = np.array([[2, 0, 0, 0], [0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 0, -1]])
    own, distance, _ = clustering.nearest(x, clustering.squared(x[:, None], centers[None]), centers, centers)
    assert own.tolist() == [1, 1] and distance.tolist() == [1, 1]


# Periodic runs


def brute_runs(x):
    out = []
    for q in range(1, len(x) // 4 + 1):
        equal = [x[i] == x[i + q] for i in range(len(x) - q)] + [False]
        at = 0
        while at < len(x) - q:
            to = at
            while equal[to]:
                to += 1
            s, e = at, to + q
            if to > at and e - s >= max(6, 4 * q) and not any(x[s:e - p] == x[s + p:e] for p in range(1, q)):
                out.append((s, e - s, q))
            at = to + 1
    return sorted(out)


def changed(doc, text):
    words = WORD.findall(text or "")
    h = crc32(str(doc).encode())
    if doc is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_digest(doc, text, change=True):
    words = changed(doc, text) if change else WORD.findall(text or "")
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_transforms_invert_and_convolve():
    rng = np.random.default_rng(3)
    for n in (2, 4, 64, 128, 4096, 65536):
        x = rng.integers(0, periodic.PRIME, (2, n)).astype(float)
        back = periodic.transform(periodic.transform(x), inverse=True) * pow(n, -1, periodic.PRIME)
        assert (back % periodic.PRIME == x).all()


def test_block_sums_are_those_of_plain_subtraction():
    rng = np.random.default_rng(6)
    for size, low, many in ((2, 1, 2), (8, 5, 6), (64, 43, 42), (128, 85, 86)):
        x = rng.integers(0, 2, 1000) * 40_000
        x[300:700] = np.resize(x[300:300 + low], 400)
        padded = np.concatenate([x, np.zeros(2 * size + low + many, np.int64)])
        starts = np.arange(0, 1000 - size, size)
        k, q = periodic.occurrences(padded, starts, size, low, many)
        plain = {(s, d) for s in starts.tolist() for d in range(low, low + many) if (padded[s:s + size] == padded[s + d:s + d + size]).all()}
        assert plain and plain <= set(zip(k.tolist(), q.tolist(), strict=True))


def test_runs_match_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 6)):
            n, kinds = rng.randint(0, 250), rng.choice([1, 2, 3, 60])
            x = [rng.randrange(kinds) for _ in range(n)]
            for _ in range(rng.randint(0, 3) if n > 10 else 0):
                a = rng.randrange(n)
                q = rng.randint(1, max(1, (n - a) // 4))
                for i in range(a + q, min(n, a + q * rng.randint(3, 8) + rng.randint(0, q))):
                    x[i] = x[i - q]
            docs.append(x)
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        found = periodic.runs(np.array(sum(docs, []), np.int64), bounds)
        assert [tuple(r) for r in found.tolist()] == [(i, *r) for i, d in enumerate(docs) for r in brute_runs(d)]


def test_periods_beyond_the_longest_transform(monkeypatch):
    monkeypatch.setattr(periodic, "LONGEST", 32)
    x = list(range(90)) * 5 + [7]
    assert periodic.runs(np.array(x), np.array([0, len(x)])).tolist() == [[0, 0, 450, 90]]
    monkeypatch.undo()
    x = np.concatenate([np.tile(np.arange(45_000), 4), np.arange(3_000)])
    assert periodic.runs(x, np.array([0, len(x)])).tolist() == [[0, 0, 183_000, 45_000]]


def test_words_equal_modulo_the_prime_are_told_apart():
    x = np.array([5, 5, 5 + periodic.PRIME, 5, 5, 5, 5, 5, 5, 5 + 2 * periodic.PRIME, 5, 5])
    assert periodic.runs(x, np.array([0, len(x)])).tolist() == [[0, 3, 6, 1]]


@pytest.mark.parametrize("change", [True, False])
def test_periodic_digests(spark, change):
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    texts = [None, "", " \n\t", "one", "a a a a a", "a a a a a a", "a\ta\na  a\x0ba\x0ca\ra a", "same line here now\n" * 80, "ü 日本 " * 9,
             "x " * 5000, " ".join(str(i) for i in range(4000)) + " end" * 7]
    texts += [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(60)]
    rows = [(i, t, "clash", 3) for i, t in enumerate(texts)] + [(7, texts[7], "clash", 3), (None, texts[7], None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int").repartition(3)
    found = periodic.digests(table, order=periodic.repeated_tail if change else None)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = [(i, t) for i, t, _, _ in rows if i not in (9, 10)]
    by = [tuple(r) for r in found.collect()]
    assert sorted((r for r in by if r[0] not in (9, 10)), key=str) == sorted((brute_digest(i, t, change) for i, t in short), key=str)
    assert len(by) == len(rows) and periodic.digests(table.where("false")).count() == 0


def test_periodic_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = {r["doc_id"]: tuple(r) for r in REGISTRY["op12_block_convolution"](spark, SF).collect()}
    assert len(found) == len(docs)
    brute = [(d, t) for d, t in docs if len((t or "").split()) <= 1500]
    assert len(brute) > 0.9 * len(docs)
    for d, t in brute:
        assert found[d] == brute_digest(d, t)


# Secret scans

KEY = {"password", "passwd", "secret", "token", "api_key", "apikey"}


def brute_rules(text):
    """Character by character, without the library's patterns."""
    text, out = text or "", []
    at = 0
    while at < len(text):
        end = None
        for k in KEY:
            if "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[at:at + len(k)]) == k:
                i = at + len(k)
                i += text[i:i + 1] in ("'", '"') and text[i:i + 1] != ""
                while text[i:i + 1] == " ":
                    i += 1
                if text[i:i + 1] not in (":", "="):
                    continue
                i += 1
                while text[i:i + 1] == " ":
                    i += 1
                i += text[i:i + 1] in ("'", '"') and text[i:i + 1] != ""
                j = i
                while j < len(text) and re.match(r"[A-Za-z0-9+/_.=-]", text[j]):
                    j += 1
                if j > i:
                    end = j
                    if j - i >= 8:
                        out.append((at, 0, j))
                    break
        at = end or at + 1
    for kind, first, chars, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), (2, "", "0123456789abcdef", 32)):
        at = 0
        while at < len(text):
            j = at + len(first)
            if text[at:j] == first:
                while j < len(text) and text[j] in chars:
                    j += 1
                if j > at + len(first):
                    if j - at >= least:
                        out.append((at, kind, j))
                    at = j
                    continue
            at += 1
    return sorted(out)


def named(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


ODD = [None, "", " ", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x', "TOKEN:abcdefgh passwd='1234567'", "password=password=12345678",
       "api_key=a1b2c3d4e5 apikey : 'zzzzzzzzz' Api_Key\"=\"qqqqqqqq", "toKen=ſecret=12345678 ſecret=12345678 toKen=12345678", "AKIA AKIAAKIA0123456789 AKIA0123456789AB akia0123456789ab",
       "a" * 31 + " " + "f" * 32 + "g" + "0" * 40, "secret = " + "Z9" * 50_000, "日本 token=abcdefgh1 🙂 " + "1a" * 20, "token = short", 'token=\n"abcdefgh"']


def test_rules_match_brute_force(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["token", "SECRET", "=", ":", " ", '"', "'", "AKIA", "AB12", "0f3a9c", "password", "_", "x-", "é"]) for _ in range(40)) for _ in range(150)]
    rows = [(i, t, "clash", 5) for i, t in enumerate(texts)] + [(3, texts[3], "clash", 5), (None, texts[3], None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hex int").repartition(3)
    found = secrets.digests(table)
    assert found.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    got = found.collect()
    want = []
    for i, t, _, _ in rows:
        base = brute_rules(t)
        want.append((i, *[sum(k == j for _, k, _ in base) for j in range(3)], hashlib.sha256(named(base).encode()).hexdigest(), named(base)))
    without = lambda spans: ",".join(s for s in spans.split(",") if not s.startswith("network"))
    assert sorted(((*r[:5], without(r["spans"])) for r in got), key=str) == sorted(want, key=str)
    assert secrets.digests(table.where("false")).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    return secrets.findings(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).cache()


def test_network_on_findings_of_other_documents(labelled):
    """Learned from half of the documents, read on the other half: findings of the rules against all other candidates."""
    net = secrets.learned(labelled.where("id % 2 = 0"))
    held = [c for r in labelled.where("id % 2 = 1").collect() for c in r["candidates"]]
    hit = {True: [], False: []}
    for c in held:
        p = net.probabilities([secrets.encoded(bytes(c["window"]), c["lead"], c["end"] - c["start"])])[0]
        hit[c["known"]].append(p >= net.thresholds[c["alphabet"]])
    assert min(map(len, hit.values())) > 50 and np.mean(hit[True]) >= 0.97 and np.mean(hit[False]) <= 0.03
    assert 0 < net.thresholds[0] < 1 and net.slope > 0


def test_network_adds_what_no_rule_finds(spark, labelled):
    net = secrets.learned(labelled)
    rng = random.Random(3)
    digest = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f"os token of {digest(31)} and the rest" for _ in range(40)] + [f"the {rng.randrange(10 ** 16):016d} and the rest" for _ in range(40)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["id"]: r["spans"] for r in secrets.with_network(secrets.findings(table), net).collect()}
    added = [any(s["kind"] == 3 for s in rows[i]) for i in range(80)]
    assert np.mean(added[:40]) > 0.9 and np.mean(added[40:]) < 0.1
    found = next(i for i in range(40) if rows[i])
    s = rows[found][0]
    assert re.fullmatch("[0-9a-f]{31}", texts[found][s["start"]:s["end"]])


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    windows = [(rng.integers(1, 130, n), (np.arange(n) > 3).astype(float)) for n in (9, 14, 30)]
    labels = np.array([1.0, 0, 1])
    net = secrets.trained(windows, labels, epochs=1)

    def loss():
        z = net.scores(windows)
        return float(np.mean(np.logaddexp(0, z) - labels * z))

    grads = secrets._batch_gradients(net, windows, labels)
    for value, grad in zip((net.embedding, net.kernel, net.bias, net.head), grads, strict=False):
        for at in rng.integers(0, value.size, 12):
            if value is net.embedding and at < secrets.EMBEDDED:
                continue
            old = value.flat[at]
            value.flat[at] = old + 1e-6
            up = loss()
            value.flat[at] = old - 1e-6
            down = loss()
            value.flat[at] = old
            assert abs((up - down) / 2e-6 - grad.flat[at]) < 1e-5


def test_long_windows_score_the_same_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    windows = [(rng.integers(1, 130, n), np.ones(n)) for n in (3, 40, 700)]
    net = secrets.trained(windows, np.array([1.0, 0, 1]), epochs=1)
    whole = net.scores(windows)
    monkeypatch.setattr(secrets, "AT_ONCE", 16)
    assert np.allclose(net.scores(windows), whole)


def test_too_few_findings_teach_nothing(spark):
    table = spark.createDataFrame([(1, ODD[3]), (2, "a 1234567890123456 b")], "doc_id long, text string")
    assert secrets.learned(secrets.findings(table)) is None
    assert {r["doc_id"]: r["n_hex"] for r in secrets.digests(table).collect()} == {1: 1, 2: 0}


def test_every_window_teaches(spark, monkeypatch):
    """More windows than any bound, and a long one, are all trained on or held out, whatever the shards."""
    texts = [f"token = {hashlib.sha256(str(i).encode()).hexdigest()[:31]}" for i in range(1700)] + [f"no {i:017d}" for i in range(1700)]
    texts += ["secret = " + "Z9" * 400]
    found = secrets.findings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).cache()
    windows = secrets.labelled_windows(found)
    assert windows.where("known").count() == 1701 and windows.where("NOT known").count() == 1700 and windows.where("size = 800").count() == 1
    monkeypatch.setattr(secrets, "SHARD_WINDOWS", 1000)
    monkeypatch.setattr(secrets, "ROUNDS", 2)
    seen = []
    real = secrets.after_round
    monkeypatch.setattr(secrets, "after_round", lambda state, shards, *a: (seen.append((shards.count(), shards.select("shard").distinct().count())), real(state, shards, *a))[1])
    once, again = secrets.learned(found), secrets.learned(found.repartition(5))
    assert set(seen) == {(3401, 4)} and windows.select("fold").distinct().count() == secrets.FOLDS
    assert np.array_equal(once.kernel, again.kernel) and np.allclose(once.thresholds, again.thresholds)


def test_long_windows_teach_the_same_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    window, net = (rng.integers(1, 130, 500), (np.arange(500) > 9).astype(float)), secrets.network(secrets.fresh())
    whole = secrets._batch_gradients(net, [window], np.array([1.0]), np.array([0.7]))
    monkeypatch.setattr(secrets, "AT_ONCE", 64)
    for x, y in zip(whole, secrets._batch_gradients(net, [window], np.array([1.0]), np.array([0.7])), strict=True):
        assert np.allclose(x, y)


def test_ranks_by_counts_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(7)
    values = [float(x) for x in np.concatenate([rng.normal(0, 1, 300), np.full(200, 0.25), [1e6, -1e6]])]
    scores = spark.createDataFrame([(x,) for x in values], "x double").cache()
    monkeypatch.setattr(secrets, "RANKED", 20)
    assert [secrets.value_at(scores, k) for k in (0, 10, 300, 501)] == [sorted(values)[k] for k in (0, 10, 300, 501)]

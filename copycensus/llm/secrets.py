"""Secrets in texts: three rules, and a character convolutional network over every further candidate and its context.

The rules find assignments, access keys and long hexadecimal runs. Any other run of ``LEAST_CANDIDATE`` key characters with a
digit is a candidate. The network sees a candidate's characters with those around it and a flag for inside or outside: an embedding
per character, one convolution, a rectifier, greatest and mean activation over the window, and one linear unit, in numpy. It
learns from findings of the rules against candidates that no rule found, each also with its context blanked out, so that a value
must be recognised by itself. Scores are calibrated to probabilities, and each alphabet (hexadecimal digits, capitals and digits,
others) has a threshold that keeps ``RECALL`` of its findings, both by scores of networks that did not see the window. Candidates at or above their threshold become spans of kind ``network``; spans of the rules always stay.

Every text is scanned once. Training, calibration and thresholds take every distinct window of all documents, of any length: the network learns
from all, and beside it ``FOLDS`` networks learn from all but one fold, by a hash, whose windows they score for the other two. Windows are dealt by a hash over shards of bounded size, whose number grows with the input.
In a round each shard goes on from the same weights over its own windows, and the weights are then averaged by the shards' sizes;
both kinds of windows weigh the same. Calibration sums over all scores, and thresholds are exact ranks found by counts in ranges.
The driver sees weights, sums and counts. With fewer than ``LEAST_LABELLED`` windows of a kind nothing is learned and no span is added.

Defined cases: a null text is empty and has no span; repeated rows each return a row; a row without an id stays; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copycensus.llm.hashing import slices
from copycensus.session import materialize

KINDS = ("assign", "access", "hex", "network")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_CANDIDATE = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_CANDIDATE)
DIGIT = re.compile(r"[0-9]")
ALPHABETS = (re.compile(r"[0-9a-fA-F]+"), re.compile(r"[A-Z0-9]+"))

#: Characters of context in front of a candidate and behind it.
BEFORE, AFTER = 24, 8
LEAST_LABELLED = 20
RECALL = 0.98
#: Windows and bytes of windows in a shard, on average; passes over all windows.
SHARD_WINDOWS, SHARD_BYTES, ROUNDS = 4000, 4 << 20, 6
#: Parts of the windows that are scored by networks trained on the others.
FOLDS = 4
#: Fractions of a weight's unit in which shards are summed, so that sums are exact in any order.
UNIT = 1 << 32
#: Scores that are ranked in the driver; more are counted in ranges first.
RANKED = 10_000

#: Codes: 0 for nothing, 1 to 128 for ASCII, 129 for all others.
CODES, EMBEDDED, WIDTH, FILTERS = 130, 8, 5, 16
#: Characters under the convolution at once.
AT_ONCE = 1 << 16


def rule_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """Start, kind, end, and start and end of the value itself, of what the rules find, in order."""
    out = []
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end(), *m.span()) for m in HEX.finditer(text)]
    return sorted(out)


def alphabet(value: str) -> int:
    return next((i for i, a in enumerate(ALPHABETS) if a.fullmatch(value)), len(ALPHABETS))


def candidates(text: str, found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, bool]]:
    """Start, end and whether a rule found it, of all values of rules and all candidates that no rule's span touches."""
    out = [(a, b, True) for a, b in sorted({(a, b) for _, _, _, a, b in found})]
    spans = sorted((s, e) for s, _, e, _, _ in found)
    at = reach = 0  # the spans that begin before a candidate ends reach this far
    for m in CANDIDATE.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][1])
            at += 1
        if reach <= m.start() and DIGIT.search(m.group()):
            out.append((*m.span(), False))
    return out


def findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, spans, candidates`` per row: the rules' spans, and the windows around values and candidates."""
    kept = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    window = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("known", pa.bool_()), ("alphabet", pa.int32()),
                        ("lead", pa.int32()), ("window", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                spans, windows = [], []
                for body in part.column(1).to_pylist():
                    body = body or ""
                    found = rule_spans(body)
                    spans.append([{"start": s, "kind": k, "end": e} for s, k, e, _, _ in found])
                    windows.append([
                        {"start": a, "end": b, "known": known, "alphabet": alphabet(body[a:b]), "lead": min(a, BEFORE),
                         "window": bytes(min(ord(c), 128) for c in body[max(0, a - BEFORE):b + AFTER])}
                        for a, b, known in candidates(body, found)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(spans, pa.list_(span)), pa.array(windows, pa.list_(window))], names=["id", "spans", "candidates"])

    kind = T.StructType.fromDDL(
        "spans array<struct<start:long,kind:int,end:long>>, "
        "candidates array<struct<start:long,end:long,known:boolean,alphabet:int,lead:int,window:binary>>")
    return kept.mapInArrow(run, T.StructType([T.StructField("id", kept.schema["_id"].dataType), *kind.fields]))


@dataclass
class Network:
    embedding: np.ndarray  # code x EMBEDDED; nothing is zero
    kernel: np.ndarray  # (WIDTH * (EMBEDDED + 1)) x FILTERS
    bias: np.ndarray
    head: np.ndarray  # greatest and mean activations
    offset: float
    slope: float = 1.0  # of the calibration
    shift: float = 0.0
    thresholds: tuple[float, ...] = ()  # by alphabet

    def columns(self, codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        x = np.concatenate([self.embedding[codes], inside[:, None]], axis=1)
        n = len(x) - WIDTH + 1
        return np.concatenate([x[k:k + n] for k in range(WIDTH)], axis=1)

    def scores(self, windows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Logits of windows (codes and inside flags), some at a time; a long window goes through the convolution in pieces."""
        out = np.zeros(len(windows))
        half = WIDTH // 2
        for i, (codes, inside) in enumerate(windows):
            codes, inside = np.pad(codes, half), np.pad(inside, half)
            most, total, n = np.full(FILTERS, -np.inf), np.zeros(FILTERS), len(codes) - 2 * half
            for at in range(0, n, AT_ONCE):
                to = min(n, at + AT_ONCE)
                a = np.maximum(self.columns(codes[at:to + 2 * half], inside[at:to + 2 * half]) @ self.kernel + self.bias, 0)
                most, total = np.maximum(most, a.max(axis=0)), total + a.sum(axis=0)
            out[i] = np.concatenate([most, total / n]) @ self.head + self.offset
        return out

    def probabilities(self, windows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return sigmoid(self.slope * self.scores(windows) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def encoded(window: bytes, lead: int, size: int, blank: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Codes and inside flags of a window; with ``blank`` the context is nothing."""
    codes = np.frombuffer(window, np.uint8).astype(np.int64) + 1
    inside = np.zeros(len(codes))
    inside[lead:lead + size] = 1
    return (np.where(inside > 0, codes, 0) if blank else codes), inside


def _long_gradients(net: Network, window: tuple[np.ndarray, np.ndarray], label: float, weight: float) -> list[np.ndarray]:
    """The same for one window of any length, in pieces."""
    half, n = WIDTH // 2, len(window[0])
    codes, inside = (np.pad(x, half) for x in window)

    def pieces() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for at in range(0, n, AT_ONCE):
            to = min(n, at + AT_ONCE) + 2 * half
            columns = net.columns(codes[at:to], inside[at:to])
            yield at, columns, np.maximum(columns @ net.kernel + net.bias, 0)

    most, total, ties = np.zeros(FILTERS), np.zeros(FILTERS), np.zeros(FILTERS, np.int64)
    for _, _, a in pieces():
        most, total = np.maximum(most, a.max(axis=0)), total + a.sum(axis=0)
    for _, _, a in pieces():
        ties += ((a == most) & (a > 0)).sum(axis=0)
    pooled = np.concatenate([most, total / n])
    error = weight * (sigmoid(pooled @ net.head + net.offset) - label)
    embedding, kernel, bias = np.zeros_like(net.embedding), np.zeros_like(net.kernel), np.zeros_like(net.bias)
    for at, columns, a in pieces():
        top = (a == most) & (a > 0)
        dz = error * (top / np.maximum(ties, 1) * net.head[:FILTERS] + net.head[FILTERS:] / n) * (a > 0)
        kernel += columns.T @ dz
        bias += dz.sum(axis=0)
        dcolumns = (dz @ net.kernel.T).reshape(-1, WIDTH, EMBEDDED + 1)[:, :, :EMBEDDED]
        for k in range(WIDTH):
            np.add.at(embedding, codes[at + k:at + k + len(dz)], dcolumns[:, k])
    embedding[0] = 0
    return [embedding, kernel, bias, pooled * error, np.array(error)]


def _batch_gradients(
    net: Network, batch: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray | None = None,
) -> list[np.ndarray]:
    """Mean gradients of the log loss: embedding, kernel, bias, head, offset."""
    weights = np.ones(len(batch)) if weights is None else weights
    if len(batch) == 1 and len(batch[0][0]) > AT_ONCE:
        return _long_gradients(net, batch[0], float(labels[0]), float(weights[0]))
    half = WIDTH // 2
    codes = np.concatenate([np.pad(c, half) for c, _ in batch])
    inside = np.concatenate([np.pad(f, half) for _, f in batch])
    sizes = np.array([len(c) for c, _ in batch])
    firsts = np.cumsum(sizes + 2 * half) - sizes - 2 * half  # a window's first place under the convolution
    owner = np.repeat(np.arange(len(batch)), sizes)
    at = np.arange(len(owner)) + np.repeat(firsts - (np.cumsum(sizes) - sizes), sizes)
    columns = net.columns(codes, inside)[at]
    z = columns @ net.kernel + net.bias
    a = np.maximum(z, 0)
    begins = np.cumsum(sizes) - sizes
    most, mean = np.maximum.reduceat(a, begins), np.add.reduceat(a, begins) / sizes[:, None]
    pooled = np.concatenate([most, mean], axis=1)
    error = weights * (sigmoid(pooled @ net.head + net.offset) - labels) / len(batch)
    top = (a == most[owner]) & (a > 0)
    ties = np.maximum(np.add.reduceat(top, begins, dtype=np.int64), 1)
    da = error[owner, None] * (top / ties[owner] * net.head[:FILTERS] + net.head[FILTERS:] / sizes[owner, None])
    dz = da * (z > 0)
    dcolumns = (dz @ net.kernel.T).reshape(-1, WIDTH, EMBEDDED + 1)[:, :, :EMBEDDED]
    embedding = np.zeros_like(net.embedding)
    for k in range(WIDTH):
        np.add.at(embedding, codes[at + k], dcolumns[:, k])
    embedding[0] = 0
    return [embedding, columns.T @ dz, dz.sum(axis=0), pooled.T @ error, np.array(error.sum())]


SHAPES = ((CODES, EMBEDDED), (WIDTH * (EMBEDDED + 1), FILTERS), (FILTERS,), (2 * FILTERS,), ())


def fresh() -> np.ndarray:
    """The state before training: the weights, their two running moments and the number of steps, in one row."""
    rng = np.random.default_rng(20)
    net = [rng.normal(0, 0.3, SHAPES[0]), rng.normal(0, 0.2, SHAPES[1]), np.zeros(SHAPES[2]), rng.normal(0, 0.2, SHAPES[3]), np.zeros(())]
    net[0][0] = 0
    weights = np.concatenate([v.ravel() for v in net])
    return np.concatenate([weights, np.zeros(2 * len(weights) + 1)])


def _parts(row: np.ndarray) -> list[np.ndarray]:
    """The weights, or moments, of a third of a state, as views."""
    ends = np.cumsum([int(np.prod(shape)) for shape in SHAPES])
    return [x.reshape(shape) for x, shape in zip(np.split(row, ends[:-1]), SHAPES, strict=True)]


def network(state: np.ndarray) -> Network:
    values = _parts(state[:len(state) // 3])
    return Network(*values[:4], float(values[4]))


def _batches(order: np.ndarray, sizes: np.ndarray, batch: int) -> Iterator[np.ndarray]:
    """Runs of ``order`` of at most ``batch`` windows and ``AT_ONCE`` characters; a longer window comes alone."""
    low = chars = 0
    for at, i in enumerate(order):
        if at > low and (at - low == batch or chars + sizes[i] > AT_ONCE):
            yield order[low:at]
            low, chars = at, 0
        chars += sizes[i]
    if len(order):
        yield order[low:]


def one_pass(state: np.ndarray, windows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray | None = None,
             seed: int = 0, batch: int = 32, rate: float = 0.01) -> np.ndarray:
    """The state after a pass over the windows in random order."""
    state = state.copy()
    n = len(state) // 3
    values, first, second = (_parts(state[k * n:(k + 1) * n]) for k in range(3))
    sizes = np.array([len(c) for c, _ in windows])
    for own in _batches(np.random.default_rng(seed).permutation(len(windows)), sizes, batch):
        state[-1] += 1
        grads = _batch_gradients(network(state), [windows[i] for i in own], labels[own], None if weights is None else weights[own])
        for v, m, s, g in zip(values, first, second, grads, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= rate * (m / (1 - 0.9 ** state[-1])) / (np.sqrt(s / (1 - 0.999 ** state[-1])) + 1e-8)
    return state


def trained(windows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = ROUNDS) -> Network:
    state = fresh()
    for seed in range(epochs):
        state = one_pass(state, windows, labels, seed=seed)
    return network(state)


def labelled_windows(found: DataFrame) -> DataFrame:
    """``known, window, lead, size, alphabet, fold``: every distinct window."""
    size = (F.col("_c.end") - F.col("_c.start")).cast("int").alias("size")
    rows = found.select(F.explode("candidates").alias("_c")).select("_c.known", "_c.window", "_c.lead", size, "_c.alphabet").distinct()
    return rows.withColumn("_h", F.xxhash64("window", "lead", "size")).withColumn("fold", F.pmod("_h", F.lit(FOLDS)).cast("int"))


def _both(group: pa.Table) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Windows with and without their context, and whether a rule found them."""
    rows = sorted(zip(*[group.column(c).to_pylist() for c in ("window", "lead", "size", "known")], strict=True))
    return [encoded(w, lead, size, blank) for w, lead, size, _ in rows for blank in (False, True)], np.array([float(k) for *_, k in rows for _ in range(2)])


def after_round(states: list[np.ndarray], shards: DataFrame, n_shards: int, weight: dict[bool, float], seed: int) -> list[np.ndarray]:
    """Of each network, all of them but the last without the fold of its number, the average of the states that its shards end with, by their numbers of windows."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        windows, labels = _both(group)
        end = one_pass(states[key[0].as_py()], windows, labels, np.where(labels == 1, weight[True], weight[False]), seed)
        return pa.table({"net": pa.array(np.full(len(end), key[0].as_py()), pa.int32()), "at": pa.array(np.arange(len(end)), pa.int32()),
                         "units": pa.array([int(round(v * UNIT)) for v in end], pa.int64()), "n": pa.array(np.full(len(end), group.num_rows), pa.int64())})

    nets = F.filter(F.sequence(F.lit(0), F.lit(len(states) - 1)), lambda k: k != F.col("fold"))
    # A number of partitions of its own: groups have few bytes and much work, and would be put together in few tasks.
    groups = shards.withColumn("net", F.explode(nets)).repartition(2 * len(states) * n_shards, "net", "shard")
    ends = groups.groupBy("net", "shard").applyInArrow(run, "net int, at int, units long, n long")
    total = F.sum(F.col("units").cast("decimal(20,0)") * F.col("n").cast("decimal(12,0)")).cast("decimal(38,0)")
    out = [state.copy() for state in states]
    for r in ends.groupBy("net", "at").agg(total.alias("s"), F.sum("n").alias("n")).collect():
        out[r["net"]][r["at"]] = int(r["s"]) / r["n"] / UNIT
    return out


def fitted(scores: DataFrame) -> tuple[float, float]:
    """The slope and shift under which scores ``x`` are likeliest probabilities of ``known``, by Newton steps over sums of all rows."""
    known = F.col("known").cast("double")
    n1, n, spread = scores.agg(F.sum(known), F.count(F.lit(1)), F.stddev_pop("x")).first()
    # Targets a little within 0 and 1, as the findings may be few; the scale of the scores is set aside so that steps are even.
    target, spread = F.when(F.col("known"), (n1 + 1) / (n1 + 2)).otherwise(1 / (n - n1 + 2)), max(float(spread), 1e-6)
    u, w = F.col("x") / spread, np.array([1.0, 0.0])

    def loss(v: np.ndarray):
        z = u * float(v[0]) + float(v[1])
        return F.sum(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - target * z) + float(0.5 * (v * v).sum())

    for _ in range(20):
        p = 1 / (1 + F.exp(-(u * float(w[0]) + float(w[1]))))
        h, d = p * (1 - p), p - target
        now, uu, u1, one, du, d1 = scores.agg(loss(w), F.sum(u * u * h), F.sum(u * h), F.sum(h), F.sum(u * d), F.sum(d)).first()
        step = np.linalg.solve(np.array([[uu, u1], [u1, one]]) + np.eye(2), np.array([du, d1]) + w)
        if np.abs(step).max() < 1e-6:
            break
        tries = scores.agg(*[loss(w - 0.5 ** k * step).alias(f"l{k}") for k in range(10)]).first()
        better = [k for k in range(10) if tries[k] <= now]
        if not better:
            break
        w = w - 0.5 ** better[0] * step
    return float(max(w[0], 1e-3)) / spread, float(w[1])


def value_at(scores: DataFrame, rank: int) -> float:
    """The score ``x`` with ``rank`` scores before it in order; counts in ranges narrow it down."""
    low, high, n = scores.agg(F.min("x"), F.max("x"), F.count(F.lit(1))).first()
    while n > RANKED and low < high:
        inside = scores.where(F.col("x").between(low, high))
        part = F.floor((F.col("x") - low) / (high - low) * 1024).alias("part")
        for r in sorted(inside.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()):
            if rank < r["n"]:
                break
            rank -= r["n"]
        low, high, n = r["low"], r["high"], r["n"]
    return low if low == high else sorted(r["x"] for r in scores.where(F.col("x").between(low, high)).select("x").collect())[rank]


def calibrated(nets: list[Network], shards: DataFrame, n_shards: int, recall: float = RECALL) -> Network:
    """The last network, with the slope and shift that fit all windows best and the thresholds that keep ``recall`` of their findings."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        columns = [group.column(c).to_pylist() for c in ("window", "lead", "size", "known", "alphabet")]
        rows = sorted(zip(*columns, strict=True))
        windows, labels = _both(group)
        return pa.table({"x": pa.array(nets[key[0].as_py()].scores(windows), pa.float64()), "known": pa.array(labels == 1),
                         "alphabet": pa.array([r[-1] for r in rows for _ in range(2)], pa.int32())})

    net, scores = nets[-1], materialize(
        shards.repartition(2 * FOLDS * n_shards, "fold", "shard").groupBy("fold", "shard").applyInArrow(run, "x double, known boolean, alphabet int"))
    net.slope, net.shift = fitted(scores)
    known = scores.where("known")
    counts = {r["alphabet"]: r["n"] for r in known.groupBy("alphabet").agg(F.count(F.lit(1)).alias("n")).collect()}

    def threshold(mine: DataFrame, n: int) -> float:
        return float(sigmoid(net.slope * value_at(mine, int(np.floor((1 - recall) * n))) + net.shift))

    whole = threshold(known, sum(counts.values()))
    # An alphabet with few findings has the threshold of all.
    net.thresholds = tuple(
        threshold(known.where(F.col("alphabet") == a), counts[a]) if counts.get(a, 0) >= LEAST_LABELLED else whole for a in range(len(ALPHABETS) + 1))
    return net


def learned(found: DataFrame, recall: float = RECALL) -> Network | None:
    """A network from all rows of ``findings``; None if there are too few labelled windows."""
    windows = materialize(labelled_windows(found))
    counts = {r["known"]: r for r in windows.groupBy("known").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("window")).alias("bytes")).collect()}
    if len(counts) < 2 or min(r["n"] for r in counts.values()) < LEAST_LABELLED:
        return None
    n = sum(r["n"] for r in counts.values())
    shards = 1 + max(n // SHARD_WINDOWS, sum(r["bytes"] for r in counts.values()) // SHARD_BYTES)
    dealt = windows.withColumn("shard", F.pmod(F.shiftright("_h", 2), F.lit(shards))).drop("_h")
    weight = {known: n / (2 * r["n"]) for known, r in counts.items()}
    states = [fresh()] * (FOLDS + 1)
    for seed in range(ROUNDS):
        states = after_round(states, dealt, shards, weight, seed)
    return calibrated([network(state) for state in states], dealt, shards, recall)


def with_network(found: DataFrame, net: Network | None) -> DataFrame:
    """``id, spans``: spans of the rules and of the network, by start and kind."""
    kind = found.schema["spans"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans, windows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                new = [w for w in windows if not w["known"]] if net else []
                if new:
                    p = net.probabilities([encoded(w["window"], w["lead"], w["end"] - w["start"]) for w in new])
                    spans = spans + [{"start": w["start"], "kind": 3, "end": w["end"]} for w, x in zip(new, p, strict=True) if x >= net.thresholds[w["alphabet"]]]
                out.append(sorted(spans, key=lambda s: (s["start"], s["kind"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, batch.schema.field(1).type)], names=["id", "spans"])

    return found.mapInArrow(run, T.StructType([found.schema["id"], T.StructField("spans", kind)]))


def joined(spans: list[dict]) -> str:
    return ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in spans)


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, spans`` per row of ``docs``."""
    found = materialize(findings(docs, doc_id, text))
    return with_network(found, learned(found))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``<doc_id>, n_assign, n_access, n_hex, base_sha256, spans`` per row."""
    rows = secret_spans(docs, doc_id, text)
    counts = ["n_assign", "n_access", "n_hex"]
    schema = T.StructType([T.StructField(doc_id, rows.schema["id"].dataType), *[T.StructField(c, T.LongType()) for c in counts],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(1).to_pylist():
                base = [s for s in spans if s["kind"] < 3]
                out.append((*[sum(s["kind"] == k for s in base) for k in range(3)], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[i] for r in out], pa.int64() if i < 3 else pa.string()) for i in range(5)]], names=schema.names)

    return rows.mapInArrow(run, schema)

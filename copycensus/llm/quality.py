"""Quality rules as a short-circuit cascade, in column expressions only.

Text statistics come first. The rules are then timed on a bounded sample in turn, and put in the order of rejected
share per second; a row leaves the cascade at the first rule that rejects it, because CASE WHEN evaluates no later branch.
The order changes the cost only: a row is kept if no rule rejects it.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows are judged one by one; other columns
pass through, and columns named like a statistic are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copycensus.llm.common import packed, words
from copycensus.session import materialize

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Rows on which costs and selectivities are estimated, and the longest text (bytes) among them. They decide the order of
#: the rules, never a verdict.
SAMPLE_ROWS = 500
SAMPLE_TEXT = 16 << 10
#: Copies of the sample in a timed run, and timed runs of each rule.
SAMPLE_TIMES = 4
REPETITIONS = 3
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for rows to drop; it may use the statistics and the word array ``_words``."""

    name: str
    rejects: Column


def _share(condition) -> Column:
    return F.size(F.filter("_words", condition))


def default_rules() -> list[Rule]:
    words_ = F.col("_words")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 14 * F.col("n_words"))),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("letters", 100 * _share(lambda w: w.rlike(r"\p{L}")) < 55 * F.col("n_words")),
        Rule("capitals", 2 * _share(lambda w: w.rlike(r"^\P{Ll}*\p{Lu}\P{Ll}*$") & (F.length(w) > 1)) > F.col("n_words")),
        Rule("stutter", 10 * F.size(F.filter(
            words_, lambda w, i: (i > 0) & (w == F.get(words_, i - 1)))) > 3 * F.col("n_words")),
        Rule("few_kinds", (F.col("n_words") >= 50) & (10 * F.size(F.array_distinct("_words")) < F.col("n_words"))),
    ]


def window_hashes(words_: Column, hashes: Column) -> Column:
    """A 64-bit hash of the words' hashes per window of eight words."""
    n = F.size(words_)
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(WINDOW)]))
    return F.when(n < WINDOW, F.array().cast("array<long>")).otherwise(windows)


def covered_words(windows: Column) -> Column:
    """Words in windows that occur twice or more.

    Only a text with an equal pair sorts its windows; the covered words are a sum over the sorted starts of repeats.
    """
    ranked = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    # The ranked array is bound to a variable, so that it is sorted once and not once per element.
    starts = lambda r: F.array_sort(F.transform(
        F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda k: (
            F.coalesce(F.get(r, k)["w"] == F.get(r, k + 1)["w"], F.lit(False))
            | F.coalesce((k > 0) & (F.get(r, F.greatest(k - 1, F.lit(0)))["w"] == F.get(r, k)["w"]), F.lit(False)))),
        lambda k: F.get(r, k)["i"]))
    fold = lambda s: F.aggregate(
        s, F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n")), lambda a: a["n"])
    counted = F.get(F.transform(F.transform(F.array(ranked), starts), fold), F.lit(0))
    return F.when(F.size(windows) == F.size(F.array_distinct(windows)), F.lit(0)).otherwise(counted)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row, _words`` and the statistics of each row of ``docs``; ``row`` holds the caller's columns under any name."""
    body = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = packed(docs).withColumn("_text", F.col("row").getField(text)).withColumns({
        "_words": words(F.col("_text")), "_lines": lines,
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
    }).withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).withColumn(
        "_windows", window_hashes(F.col("_words"), F.col("_hashes")))
    return counted.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered_words(F.col("_windows")).cast("long"),
    }).drop("_text", "_lines", "_hashes", "_windows")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def order_rules(docs: DataFrame, text: str, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejected share per second, best first, estimated on about ``sample_rows`` distinct texts.

    The sample is the short texts below a bound of their hash, from all partitions; no other text leaves its task. Its
    rows are repeated until the costs stand out from the noise, and each rule's time is the least of ``REPETITIONS`` runs in
    turn, above that of a rule that rejects nothing. Equal ranks, in steps of half a power of two, go by name.
    """
    text = F.col(f"`{text}`")
    short = docs.where(F.octet_length(text) <= SAMPLE_TEXT).select(F.xxhash64(text).alias("h"), text.alias("text"))
    bound = int(min(1.0, sample_rows / max(1, docs.count())) * (1 << 62))
    chosen = short.where(F.pmod("h", F.lit(1 << 62)) < bound).groupBy("h").agg(F.min("text").alias("text")).collect()
    local = docs.sparkSession.createDataFrame(sorted((r["text"],) for r in chosen), "text string")
    stats = materialize(with_statistics(local).drop("row"))
    sample = materialize(stats.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_TIMES)))).drop("_again"))
    share = sample.agg(*[F.avg(F.when(r.rejects, 1.0).otherwise(0.0)).alias(f"r{i}") for i, r in enumerate(rules)]).first()

    def run(condition: Column) -> float:
        start = time.perf_counter()
        sample.agg(F.count(F.when(condition, 1))).collect()
        return time.perf_counter() - start

    # A comparison of the words with nothing has the cost of reading them.
    floor = F.size("_words") < 0
    seconds = [[run(c) for c in (floor, *[r.rejects for r in rules])] for _ in range(REPETITIONS)]
    least = [min(x) for x in zip(*seconds, strict=True)]

    def rank(i: int) -> int:
        gain = (share[i] or 0.0) / max(least[i + 1] - least[0], 0.02 * least[0])
        return round(2 * math.log2(gain)) if gain > 0 else -10_000

    order = sorted(range(len(rules)), key=lambda i: (-rank(i), rules[i].name))
    return [rules[i] for i in order]


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects a row, or null; later rules are not evaluated."""
    verdict = F.when(base_failed(), F.lit("base"))
    for rule in rules:
        verdict = verdict.when(rule.rejects, F.lit(rule.name))
    return verdict


def judged(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``row`` (the caller's columns), the statistics, ``base_failed``, ``rejected_by`` and ``kept``."""
    rules = default_rules() if rules is None else rules
    rows = with_statistics(docs, text)
    ordered = order_rules(docs, text, rules, sample_rows)
    return rows.withColumns({"base_failed": base_failed(), "rejected_by": cascade(ordered)}).withColumn(
        "kept", F.col("rejected_by").isNull()).drop("_words")


def judge(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add the statistics, ``base_failed``, ``kept`` and ``rejected_by``; columns of these names are replaced, all others stay."""
    rows = judged(docs, text, rules, sample_rows)
    added = [c for c in rows.columns if c != "row"]
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in added]
    return rows.select(*own, *added)

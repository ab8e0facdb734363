"""Token counts of sections by offset-mapped attribution.

A document is encoded once and whole. Token byte lengths give each token's character span, and the spans are joined with
the sections' spans by binary search. A token that crosses a boundary is allocated by a stated rule:

* ``first``: to every section that holds its first character (sections may nest or overlap);
* ``most``: to the one section with most of its characters, the earlier one in a tie (sections must not overlap).

Sections that tile a text share out exactly its tokens under either rule.

Defined cases: a null or empty text has one empty section without tokens; a null section list is taken as empty and gives
no rows; spans beyond the text count what exists; repeated rows are attributed one by one; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copycensus.llm.hashing import slices

VOCABULARY = "byte_bpe_50k.tiktoken"
SPANS = "array<struct<start:bigint,end:bigint>>"


@cache
def encoding(vocabulary: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer and the byte length of every token."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, rank in ranks.items():
        lengths[rank] = len(piece)
    return tiktoken.Encoding("sections", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and last character + 1 of every token; tokens that share a character both span it."""
    own, lengths = encoding(vocabulary)
    data = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(lengths[np.array(own.encode_ordinary(text), np.int64)])
    character = np.cumsum((data & 0xC0) != 0x80)  # number of the character that a byte belongs to, from 1
    if not len(ends):
        return ends, ends
    return character[np.concatenate([[0], ends[:-1]])] - 1, character[ends - 1]


def attribute(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens allocated to each span and tokens that cross one of its boundaries. ``spans``: rows of start, end."""
    left, right = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0])
    crossing = lambda at: np.searchsorted(starts, at, "left") - np.searchsorted(ends, at, "right")
    crossed = np.where(right > left, np.maximum(crossing(left), 0) + np.maximum(crossing(right), 0), 0)
    if rule == "first":
        counts = np.searchsorted(starts, right, "left") - np.searchsorted(starts, left, "left")
        return np.maximum(counts, 0), crossed
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    counts = np.zeros(len(spans), np.int64)
    # The spans that a token meets are consecutive; nearly every token meets one.
    low, high = np.searchsorted(right, starts, "right"), np.searchsorted(left, ends, "left")
    one = high - low == 1
    np.add.at(counts, low[one], 1)
    for t in np.flatnonzero(high - low > 1):
        shared = np.minimum(right[low[t]:high[t]], ends[t]) - np.maximum(left[low[t]:high[t]], starts[t])
        if shared.max() > 0:
            counts[low[t] + int(np.argmax(shared))] += 1
    out = np.zeros_like(counts)
    out[order] = counts
    return out, crossed


def count_sections(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spans: str | None = None, rule: str = "first",
    vocabulary: str | None = None,
) -> DataFrame:
    """One row per document and section: ``section, start_char, end_char, n_tokens, n_crossing, doc_tokens``.

    Without a ``spans`` column the sections are the text's lines, each with its line end.
    """
    if rule not in ("first", "most"):
        raise ValueError(f"unknown rule {rule}")
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kept = docs.select(doc_id, text, *([F.col(spans).cast(SPANS).alias("_spans")] if spans else []))
    names = ["section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"]
    schema = T.StructType([kept.schema[0], *[T.StructField(n, T.LongType()) for n in names]])

    def lines(body: str) -> np.ndarray:
        ends = np.cumsum([len(x) + 1 for x in body.split("\n")])
        ends[-1] -= 1
        if len(ends) > 1 and ends[-1] == ends[-2]:
            ends = ends[:-1]  # a final line end closes the last section
        return np.stack([np.concatenate([[0], ends[:-1]]), ends], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                given = part.column(2).to_pylist() if spans else [None] * part.num_rows
                index, columns = [], [[] for _ in names]
                for row, (body, own) in enumerate(zip(part.column(1).to_pylist(), given, strict=True)):
                    body = body or ""
                    starts, ends = token_spans(body, path)
                    if spans:
                        own = [(s["start"] or 0, s["end"] or 0) for s in own or [] if s is not None]
                        cut = np.array(own, np.int64).reshape(-1, 2)
                    else:
                        cut = lines(body)
                    counts, crossed = attribute(starts, ends, cut, rule)
                    n = len(cut)
                    index.append(np.full(n, row))
                    for c, v in zip(columns, (np.arange(n), cut[:, 0], cut[:, 1], counts, crossed, np.full(n, len(starts))), strict=True):
                        c.append(v)
                if index:
                    ids = part.column(0).take(pa.array(np.concatenate(index)))
                    yield pa.RecordBatch.from_arrays(
                        [ids, *(pa.array(np.concatenate(c).astype(np.int64)) for c in columns)], names=schema.names)

    return kept.mapInArrow(run, schema)

"""Byte-level BPE through a sentencepiece model that is serialised from the vocabulary itself.

Every byte is mapped to one printable character, every vocabulary entry becomes a BPE piece whose score is its negative
rank, and normalisation is the identity. Sentencepiece then merges the pair of best score, leftmost first, which is the
merge of least rank. Each match of the pre-token pattern is encoded on its own; decoding maps pieces back to bytes.

Defined cases: a null text is the empty text and has no tokens; repeated rows stay; other columns pass through; texts are
taken whole; an empty table gives an empty table. The model and the piece table are the same size whatever the input.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens remembered by a worker, besides those of one part of a batch; the memory is emptied when it is full. A worker keeps
#: it when its task is over, beside whatever a later stage needs.
REMEMBERED = 100_000
#: Bytes of text in one part of a batch.
PART_BYTES = 1 << 20


def byte_characters() -> list[str]:
    """The character of each byte: itself if it is printable Latin-1, else one from U+0100 on, in byte order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    kept = set(plain)
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialised_model(ranked: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece i is entry i with score -i; one more piece is the unknown."""
    to_char = byte_characters()
    out = bytearray()
    for rank, entry in enumerate(ranked):
        piece = "".join(to_char[b] for b in entry).encode()
        out += _field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -float(rank)) + _flag(3, 1))
    out += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _flag(3, 2))
    out += _field(2, _flag(3, 2) + _flag(40, len(ranked)))  # trainer: BPE, the unknown's id
    out += _field(3, _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0))  # no prefix, trimming, escaping
    return bytes(out)


class Codec:
    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = sorted(ranks, key=ranks.get)
        if [ranks[p] for p in self.pieces] != list(range(len(ranks))):
            raise ValueError("Ranks must be 0, 1, 2, ... without a gap.")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(self.pieces))
        self.to_char = {b: c for b, c in enumerate(byte_characters())}
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.decimal = list(map(str, range(len(ranks))))
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[tuple[int, ...]]:
        """Ids by pre-token."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[tuple[int, ...]]]:
        cut = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = list({p for pre in cut for p in pre if p not in known})
        mapped = [p.encode().decode("latin-1").translate(self.to_char) for p in new]
        known.update(zip(new, map(tuple, self.model.encode(mapped, num_threads=1)), strict=True))
        return [[known[p] for p in pre] for pre in cut]

    def decode(self, ids: list[int]) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids])


@cache
def codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


def encode_documents(docs: DataFrame, text: str = "text", vocabulary: str | None = None, decode: bool = True) -> DataFrame:
    """Add ``token_ids`` (array of int) and, if asked, ``decoded`` (the bytes that the ids stand for)."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    added = [T.StructField("token_ids", T.ArrayType(T.IntegerType()))]
    if decode:
        added.append(T.StructField("decoded", T.BinaryType()))
    names = {f.name for f in added}
    kept = docs.select(*[c for c in docs.columns if c not in names])
    schema = T.StructType([*kept.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in slices(batch, text):
                ids = [[i for p in pre for i in p] for pre in own.encode_all([t or "" for t in part.column(text).to_pylist()])]
                columns = [*part.columns, pa.array(ids, pa.list_(pa.int32()))]
                if decode:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(run, schema)


def digest_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked, ``token_ids``.

    The digests are those of what ``encode_documents`` returns, taken in the same pass: the ids joined by blanks, and the
    bytes that they decode to.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kept = docs.select(doc_id, text)
    fields = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    if with_ids:
        fields.append(("token_ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())))
    schema = T.StructType([kept.schema[0], *[T.StructField(n, t) for n, t, _ in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in slices(batch, text):
                columns = [[] for _ in fields]
                for pre in own.encode_all([t or "" for t in part.column(1).to_pylist()]):
                    ids = [i for p in pre for i in p]
                    row = [len(ids), hashlib.sha256(" ".join([own.decimal[i] for i in ids]).encode()).hexdigest(),
                           hashlib.sha256(own.decode(ids)).hexdigest(), ids]
                    for column, value in zip(columns, row, strict=False):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, t) for c, (_, _, t) in zip(columns, fields, strict=True))], names=schema.names)

    return kept.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, so that memory follows one part."""
    rows = max(1, int(batch.num_rows * most / max(1, batch.column(batch.schema.get_field_index(text)).nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)

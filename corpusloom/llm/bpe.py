"""Operator 9, byte-level BPE: encoding and decoding through sentencepiece.

A sentencepiece BPE model is serialised here, byte by byte, from a rank file:
each vocabulary entry becomes a piece of 256 printable stand-ins for bytes,
scored by its negative rank (so the lowest rank merges first), with identity
normalisation and without dummy prefix or whitespace escaping.  Piece number and
rank are the same, so ids are those of the rank file.  Texts are split by the
vocabulary's pattern (array operations), each distinct pre-token is encoded once
per worker, and decoding concatenates the bytes of the ids.

Defined results: a null text has null ids, an empty one an empty list; any
Unicode text decodes to itself (`exact` says so for every row); null and repeated
ids and repeated rows are carried along row by row; other columns are never
read; an empty table gives an empty result.  Nothing is shuffled, and memory
doesn't depend on text length beyond one document.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretokens, shared, textops

VOCABULARY = os.environ.get("BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Distinct pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 300_000


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranked = {int(r): base64.b64decode(b) for b, r in pairs}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError(f"{path}: ranks must count from 0 without gaps")
    return [ranked[r] for r in range(len(ranked))]


def stand_ins() -> str:
    """One printable character for each byte: itself where printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(more)
            more += 1
    return "".join(out)


def _varint(x: int) -> bytes:
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes([*out, x])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose piece i is the vocabulary entry of rank i; the unknown piece comes last."""
    marks = stand_ins()
    pieces = []
    for rank, b in enumerate(ranks):
        text = b.decode("latin-1").translate(dict(enumerate(marks))).encode()
        pieces.append(_field(1, _field(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _field(3, 1)))
    pieces.append(_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2)))
    none = 2**64 - 1  # -1: the model has no such piece
    trainer = _field(2, _field(3, 2) + _field(4, len(pieces)) + _field(40, len(ranks)) + _field(41, none) + _field(42, none) + _field(43, none))
    normal = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return b"".join(pieces) + trainer + normal


class Bpe:
    """Encoder and decoder of one vocabulary, with the pre-tokens seen so far."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.whole = {b: r for r, b in enumerate(self.ranks)}
        self.marks = dict(enumerate(stand_ins()))
        self.flat = np.frombuffer(b"".join(self.ranks), np.uint8)
        self.size = np.fromiter(map(len, self.ranks), np.int64, len(self.ranks))
        self.at = np.cumsum(self.size) - self.size
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.used = 0
        self.begin = np.empty(1 << 14, np.int64)
        self.count = np.empty(1 << 14, np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Encodes pre-tokens, none of them known."""
        new = list(dict.fromkeys(pieces))
        raw = [p.encode("utf-8") for p in new]
        coded = self.model.encode([b.decode("latin-1").translate(self.marks) for b in raw], num_threads=1)
        coded = [[r] if (r := self.whole.get(b)) is not None else c for b, c in zip(raw, coded)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        total, have = int(sizes.sum()), len(self.known)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        while have + len(new) > len(self.begin):
            self.begin, self.count = (np.concatenate((x, np.empty_like(x))) for x in (self.begin, self.count))
        self.ids[self.used : self.used + total] = np.fromiter((i for c in coded for i in c), np.int32, total)
        self.begin[have : have + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.count[have : have + len(new)] = sizes
        self.used += total
        self.known.update(zip(new, range(have, have + len(new))))

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The number of each pre-token in begin and count."""
        if len(self.known) > REMEMBERED:
            self.forget()
        missing = [p for p in pieces if p not in self.known]
        if missing:
            self.learn(missing)
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def counts(self, pieces: list[str]) -> np.ndarray:
        """How many ids each pre-token has."""
        k = self.numbers(pieces)
        return self.count[k]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and how many of them each text has."""
        pieces, per_text = pretokens.split(texts)
        k = self.numbers(pieces)
        sizes = self.count[k]
        ids = self.ids[textops.ragged(self.begin[k], sizes)]
        edge = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(per_text)))]
        return ids, np.diff(edge)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.flat[textops.ragged(self.at[ids], self.size[ids])].tobytes()


@lru_cache(2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids, n_tokens and whether the ids decode to the text."""
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            column = b.column(1)
            texts = [t or "" for t in column.to_pylist()]
            for i, j in textops.chunks(texts):
                ids, per_text = bpe.encode(texts[i:j])
                size = np.concatenate(([0], np.cumsum(bpe.size[ids])))
                edge = np.concatenate(([0], np.cumsum(per_text)))
                raw = bpe.decode(ids)
                cut = size[edge].tolist()
                exact = [raw[cut[k] : cut[k + 1]] == texts[i + k].encode("utf-8", "surrogatepass") for k in range(j - i)]
                null = column.slice(i, j - i).is_null()
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids), mask=null)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), lists, pa.array(per_text, mask=null.to_numpy(zero_copy_only=False)), pa.array(exact)],
                    names=["doc_id", "ids", "n_tokens", "exact"],
                )

    return docs.select("doc_id", "text").mapInArrow(lambda it: shared.trimmed(run(it)), "doc_id long, ids array<int>, n_tokens long, exact boolean")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and the text of its ids; null where the ids are null. Bytes that aren't UTF-8 (of cut ids) become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            out = [None if x is None else bpe.decode(np.asarray(x, np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

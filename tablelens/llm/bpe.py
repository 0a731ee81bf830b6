"""Byte-level BPE by a sentencepiece model that is written directly from a rank vocabulary.

Each of the 256 bytes is shown as one printable character, each token as the characters of its bytes
with minus its rank as score, and nothing is normalised. Merging the best-scored pair first is then
merging the lowest rank first, so sentencepiece gives the ids that the ranks define. Pre-tokens are
encoded on their own; ids are turned back by the inverse mapping.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words whose ids a worker remembers, and words of one text taken at a time.
REMEMBERED, WINDOW = 200_000, 500_000
#: Rows returned at a time.
ROWS = 256
#: Unicode white space, as `\\s` in the pattern means it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if it prints, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown, spare = dict.fromkeys(plain), 256
    for b in range(256):
        if b in shown:
            shown[b] = chr(b)
        else:
            shown[b] = chr(spare)
            spare += 1
    return [shown[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        ranked = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines) if rank}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return [ranked[i] for i in range(len(ranked))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer message: whole numbers, single floats, or bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece model of a rank vocabulary: id = rank; an unknown piece, never used, is last."""
    shown = byte_characters()
    missing = set(range(256)) - {t[0] for t in tokens if len(t) == 1}
    if missing:
        raise ValueError(f"no token for the bytes {sorted(missing)}")
    pieces = [("".join(shown[b] for b in t), -float(rank), 1) for rank, t in enumerate(tokens)]
    pieces.append(("<unk>", 0.0, 2))
    out = [_field(1, _field(1, p.encode()) + _field(2, score) + _field(3, kind)) for p, score, kind in pieces]
    # trainer: BPE, size, white space not marked, ids of <unk> and of the absent <s>, </s>, <pad>
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens))
    trainer += _field(41, -1) + _field(42, -1) + _field(43, -1)
    # normaliser: identity, no dummy prefix, white space neither removed nor escaped
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class _Words(dict):
    """Ids by word, as bytes, worked out when a word is first asked for."""

    def __init__(self, ids_of):
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.ids_of(word)
        return ids


class Codec:
    """Encoder and decoder of one vocabulary and pre-token pattern; made once in each worker.

    No match of the pattern may go on from other characters into white space, as is usual: then a word
    with the white space before it is split into the same pre-tokens wherever it stands, and its ids can
    be remembered.
    """

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pretokens = regex.compile(pattern).findall
        self.words = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        shown = byte_characters()
        back = {c: b for b, c in enumerate(shown)}
        self.table = {b: ord(c) for b, c in enumerate(shown)}
        pieces = (self.processor.id_to_piece(i) for i in range(self.processor.unk_id()))
        self.tokens = [bytes(back[c] for c in piece) for piece in pieces]
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.known = _Words(self.ids_of)

    def ids_of(self, word: str) -> bytes:
        """The ids as four bytes each: remembered and joined without a number object for each."""
        ids: list[int] = []
        for raw in map(str.encode, self.pretokens(word)):
            # a pre-token that is a token needs no merges, also if no merges would lead to it
            at = self.whole.get(raw)
            ids += self.processor.encode(raw.decode("latin-1").translate(self.table)) if at is None else (at,)
        return np.array(ids, np.int32).tobytes()

    def _windows(self, text: str) -> Iterator[list[str]]:
        if len(text) <= WINDOW:
            yield self.words.findall(text)
            return
        words = (m.group() for m in self.words.finditer(text))
        while window := list(islice(words, WINDOW)):
            yield window

    def encode(self, text: str | None) -> np.ndarray:
        parts = []
        for window in self._windows(text or ""):
            if len(self.known) > REMEMBERED:  # the first to come are the frequent ones
                for word in list(islice(self.known, REMEMBERED // 2, None)):
                    del self.known[word]
            parts.append(b"".join(map(self.known.__getitem__, window)))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, [] if ids is None else ids))


@lru_cache(maxsize=4)
def _codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


def tokenizer(path: str, pattern: str) -> tuple[bytes, str]:
    """What `encode` and `decode` need: the model written from the file of ranks, and the pattern."""
    return serialise(read_ranks(path)), pattern


def _added(docs: DataFrame, fields: list[T.StructField], columns) -> DataFrame:
    """docs with columns made by `columns(batch) -> arrays`, a few rows at a time so that memory stays small."""
    names = {f.name for f in fields}
    kept = [c for c in docs.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                arrays = [batch.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays(arrays + columns(batch), [*kept, *(f.name for f in fields)])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *fields]))


def encode_documents(docs: DataFrame, with_: tuple[bytes, str], text: str = "text", decoded: bool = False) -> DataFrame:
    """All columns of docs with `ids` (array<int>) added or replaced, and if asked `decoded` (binary) from them.

    One pass without a shuffle. Null and empty texts give no ids. Each row stands alone, so repeated rows
    give repeated results and an empty table an empty one. Texts of any length are encoded whole, a window
    of words at a time. docs must not have two columns of one name.
    """
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)]
    fields += [T.StructField("decoded", T.BinaryType(), False)] * decoded

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(*with_)
        ids = [codec.encode(t) for t in batch.column(text).to_pylist()]
        offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        flat = pa.array(np.concatenate(ids))
        item = pa.field("element", pa.int32(), nullable=False)
        arrays = [pa.ListArray.from_arrays(pa.array(offsets), flat, type=pa.list_(item))]
        return arrays + [pa.array([codec.decode(x.tolist()) for x in ids], pa.binary())] * decoded

    return _added(docs, fields, columns)


def decode_documents(docs: DataFrame, with_: tuple[bytes, str], ids: str = "ids") -> DataFrame:
    """All columns of docs with `decoded` (binary) added or replaced: the bytes that ids stand for.

    Null and empty arrays give empty bytes; bytes that are no UTF-8 stay as they are.
    """

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(*with_)
        return [pa.array([codec.decode(x) for x in batch.column(ids).to_pylist()], pa.binary())]

    return _added(docs, [T.StructField("decoded", T.BinaryType(), False)], columns)

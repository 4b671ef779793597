"""Problem 8: encode a corpus with a public byte-level BPE vocabulary (p8).

Method: the rank file of the vocabulary is serialised directly into a sentencepiece BPE model.
Every token becomes a piece spelled with one printable character per byte, its score is the
negative rank (so the merge of lowest rank wins, as in byte-level BPE) and normalisation is
identity. Texts are split into pre-tokens by the vocabulary's own pattern and each pre-token is
encoded on its own; decoding maps pieces back to bytes.

Defined results: a null text has ``ids`` null in :func:`encode` unless ``null_ids`` is ``"empty"``
(the default), which gives ``[]``; an empty text has ``[]``; special tokens' strings in a text are
ordinary text. Other columns of the input are kept; a column named like the output is replaced.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("LOOMDEX_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens up to this length are remembered per worker, at most so many at a time.
CACHED_CHARS, CACHED_ENTRIES = 40, 400_000


def byte_alphabet() -> list[str]:
    """One printable character per byte: bytes that print in Latin-1 stand for themselves,
    the rest follow from code point 256 on."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in itself else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _bytes_field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, ordered by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks have gaps; ids would not equal piece indexes")
    return [token for _, token in ranked]


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose piece index is the token's rank.

    Field numbers follow the public sentencepiece_model.proto: pieces 1 (piece 1, score 2,
    type 3), trainer_spec 2 (model_type 3, unk/bos/eos/pad ids 40-43), normalizer_spec 3
    (name 1, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5).
    """
    spell = byte_alphabet()
    normal, unknown, bpe, none = 1, 2, 2, (1 << 64) - 1

    def piece(text: str, score: float, kind: int) -> bytes:
        body = _bytes_field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _int_field(3, kind)
        return _bytes_field(1, body)

    pieces = [piece("".join(spell[b] for b in token), -float(rank), normal) for rank, token in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, unknown))
    trainer = _int_field(3, bpe) + _int_field(40, len(tokens)) + b"".join(_int_field(k, none) for k in (41, 42, 43))
    normalizer = _bytes_field(1, b"identity") + b"".join(_int_field(k, 0) for k in (3, 4, 5))
    return b"".join(pieces) + _bytes_field(2, trainer) + _bytes_field(3, normalizer)


class Encoder:
    """Encodes and decodes on one worker."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(PATTERN).findall
        self.spell = dict(enumerate(byte_alphabet()))
        self.unspell = {ord(c): b for b, c in self.spell.items()}
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for part in self.split(text):
            ids = known.get(part)
            if ids is None:
                ids = self.sp.encode(part.encode("utf-8", "replace").decode("latin-1").translate(self.spell))
                if len(part) <= CACHED_CHARS:
                    if len(known) >= CACHED_ENTRIES:
                        known.clear()
                    known[part] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        spelled = "".join(self.sp.id_to_piece(int(i)) for i in ids)
        return bytes(self.unspell[ord(c)] for c in spelled).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def worker_encoder(model: bytes) -> Encoder:
    """The encoder of this Python worker, built once."""
    key = hash(model)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def model_bytes(tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> bytes:
    return serialise_model(read_ranks(os.path.join(tokenizer_dir, f"{tokenizer}.tiktoken")))


def _shared_model(spark, tokenizer: str, tokenizer_dir: str):
    # about 1 MB whatever the corpus: its size is the vocabulary's
    return spark.sparkContext.broadcast(model_bytes(tokenizer, tokenizer_dir))


def ids_column(df: DataFrame, text: Column, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> Column:
    """Token ids of ``text`` as array<int>; null stays null."""
    model = _shared_model(df.sparkSession, tokenizer, tokenizer_dir)

    @F.pandas_udf("array<int>")
    def encode_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = worker_encoder(model.value)
        for texts in batches:
            yield pd.Series([None if t is None else encoder.encode(t) for t in texts], dtype=object)

    return encode_ids(text)


def count_column(df: DataFrame, text: Column, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> Column:
    """Number of tokens of ``text``; null stays null."""
    model = _shared_model(df.sparkSession, tokenizer, tokenizer_dir)

    @F.pandas_udf("long")
    def count_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = worker_encoder(model.value)
        for texts in batches:
            yield pd.Series([None if t is None else len(encoder.encode(t)) for t in texts], dtype="Int64")

    return count_ids(text)


def decode_column(df: DataFrame, ids: Column, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> Column:
    """Text of token ids; null stays null."""
    model = _shared_model(df.sparkSession, tokenizer, tokenizer_dir)

    @F.pandas_udf("string")
    def decode_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = worker_encoder(model.value)
        for rows in batches:
            yield pd.Series([None if r is None else encoder.decode(r) for r in rows], dtype=object)

    return decode_ids(ids)


def encode(df: DataFrame, text_col: str = "text", out_col: str = "ids", null_ids: str = "empty",
           tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """One row out for every row in, with ``out_col`` added. Empty and null texts never reach
    Python: their ids are defined by ``null_ids`` and the empty list."""
    if null_ids not in ("empty", "null"):
        raise ValueError("null_ids is 'empty' or 'null'")
    text = F.col(text_col)
    ids = ids_column(df, text, tokenizer, tokenizer_dir)
    return df.withColumn(out_col, F.coalesce(ids, F.array().cast("array<int>")) if null_ids == "empty" else ids)


def round_trip_failures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Ids of rows whose decoded ids differ from the text; empty when the encoding is lossless."""
    done = df.select(id_col, text_col).withColumn("ids", ids_column(df, F.col(text_col), **kw))
    return done.where(decode_column(df, F.col("ids"), **kw) != F.col(text_col)).select(id_col)

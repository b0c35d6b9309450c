"""Encoding whole corpora with a public byte-level tokenizer, and decoding ids back to text.

The merges come from a local rank file (a parameter, never copied). Long texts are pre-split at boundaries that the
tokenizer's own pattern can never cross, so a text of any length is encoded piece by piece with the same ids.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed: the published split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A match of the pattern has white space only at its front, and never a letter beside a digit.
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
LONG = 100_000


@lru_cache(maxsize=4)
def encoding(ranks: str = RANKS):
    """The tokenizer of a rank file; one per worker process."""
    import tiktoken

    with Path(ranks).open("rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(Path(ranks).name, pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def safe_pieces(text: str, size: int = LONG) -> list[str]:
    """``text`` cut at the first safe boundary after every ``size`` characters; whole where there is none."""
    if len(text) <= size:
        return [text]
    pieces, at = [], 0
    while len(text) - at > size and (m := SAFE.search(text, at + size)):
        pieces.append(text[at : m.start()])
        at = m.start()
    return [*pieces, text[at:]]


def encode_text(text: str | None, ranks: str = RANKS, size: int = LONG) -> list[int]:
    """Ids of one text; null and empty texts have none. Strings that look like special tokens are ordinary text."""
    if not text:
        return []
    enc = encoding(ranks)
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for piece in safe_pieces(text, size) for i in enc.encode_ordinary(piece)]


def ids(text: str | Column, ranks: str = RANKS) -> Column:
    """Column of token ids (array of int). Null and empty texts give an empty array, blank ones are encoded."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array([encode_text(t, ranks) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return encode(text)


def n_tokens(text: str | Column, ranks: str = RANKS) -> Column:
    """Column of token counts (int), without sending the ids back to the JVM; 0 for null and empty texts."""

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(encode_text(t, ranks)) for t in texts.to_pylist()], pa.int32())

    return count(text)


def text_of(tokens: str | Column, ranks: str = RANKS) -> Column:
    """Decodes through raw bytes, so tokens that are parts of a character come out whole; null ids give null.

    Unknown ids, and bytes that form no character, become U+FFFD.
    """

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        enc = encoding(ranks)
        size = enc.max_token_value

        def raw(i: int | None) -> bytes:
            try:
                return enc.decode_single_token_bytes(i) if i is not None and 0 <= i <= size else b"\xff"
            except KeyError:
                return b"\xff"

        return pa.array([None if x is None else b"".join(map(raw, x)).decode("utf-8", "replace") for x in lists.to_pylist()], pa.string())

    return decode(tokens)


def encode_corpus(df: DataFrame, text: str = "text", out: str = "ids", ranks: str = RANKS) -> DataFrame:
    """``df`` with the column ``out`` of token ids; a column of that name is replaced. Rows are kept as they are."""
    return df.withColumn(out, ids(F.col(f"`{text}`"), ranks))

"""Sizes of texts in tokens of a public tokenizer, as columns."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits text before byte-pair merges, as the byte-level BPE vocabularies expect.
BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_tokens(text: Column) -> Column:
    """Tokens of the byte tokenizer (ByT5): one for each byte of the UTF-8 text, no end token. Null texts have none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def bpe_counter(vocabulary: str) -> Callable[[bytes], int]:
    """A function that counts the tokens of a text's bytes, made once in a worker."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text.decode("utf-8", "replace")))


def bpe_tokens(text: Column, vocabulary: str) -> Column:
    """Tokens of a byte-level BPE, given the path of its ranks file (.tiktoken), which every executor must be able to read.

    Null texts have none. Bytes that are no UTF-8 count as the replacement character does."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = bpe_counter(vocabulary)
        for texts in batches:
            yield pd.Series([0 if t is None else tokens(bytes(t)) for t in texts], dtype="int64")

    return count(text.cast("binary"))

"""Exact numbers of tokens by a public vocabulary; ``text.estimated_tokens`` is the estimate where none is at hand."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def encoder(path: str, pattern: str):
    """The encoder of a vocabulary file of tiktoken, once a process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> tuple[str, str]:
    """Path and split pattern of the installed public byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def exact_tokens(vocabulary: tuple[str, str] | None = None) -> Callable[[Column], Column]:
    """A function of a text column: the number of its tokens by a vocabulary (path and split pattern, at the same place on
    all executors); null for null, 0 for an empty text."""
    path, pattern = vocabulary or default_vocabulary()

    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(str(path), pattern).encode_ordinary
        return pd.Series([None if x is None else len(encode(x)) for x in texts], dtype="Int64")

    return F.pandas_udf(count, "long")

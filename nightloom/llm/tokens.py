"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Byte-level BPE ranks, on every machine of the cluster; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which the byte-level vocabularies were split.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# A single line break between visible characters always ends a piece of PATTERN.
_SEAM = re.compile(r"(?<=\S\n)(?=\S)")
_LONG = 200_000


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a text; 0 for null and the empty text. Long texts are counted line by line, with the same result."""
    if not text:
        return 0
    encode = _encoding(path).encode_ordinary
    if len(text) <= _LONG:
        return len(encode(text))
    return sum(len(encode(piece)) for piece in _SEAM.split(text))


def with_token_counts(df: DataFrame, text: str, out: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """``df`` plus ``out``, the size of ``text`` in tokens; 0 for null and empty texts."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([count_tokens(t, path) for t in texts], dtype="int32")

    return df.withColumn(out, F.pandas_udf(work, "int")(F.col(text)))

"""Sizes of texts in tokens of a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, functions as F

#: Where the vocabulary lies on every node; it is never copied into the package.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the public rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _count(vocabulary: str, pattern: str):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(vocabulary, pattern).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b["text"]]
            yield b.drop(columns="text").assign(n_tokens=pd.Series(sizes, dtype="int64", index=b.index))

    return run


def token_counts(df: DataFrame, id_col: str, text_col: str, keep: dict[str, str] | None = None, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, the columns named in ``keep`` as new name -> old name, n_tokens), whole texts; a null text has 0 tokens.

    Rows without id take no part; an id that occurs again counts once.
    """
    keep = keep or {}
    rows = df.select(F.col(id_col).alias("id"), *[F.col(old).alias(new) for new, old in keep.items()], F.col(text_col).cast("string").alias("text")).where("id is not null")
    fields = [f for f in rows.schema.fields if f.name != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long"
    return rows.mapInPandas(_count(vocabulary, pattern), kinds).dropDuplicates(["id"])

"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.session import spread

#: Where the vocabulary files lie, and which one is used unless a caller names another.
TOKENIZER_DIR = os.environ.get("LAWLOOM_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_multi_50k.tiktoken"

# Fixed value: the pattern that splits text before the merges of the rank files.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(records: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """item_id, n_tokens (null and empty texts 0) and the columns ``keep``. Texts never leave the task that reads them."""
    path = path or f"{TOKENIZER_DIR}/{RANKS}"
    rows = spread(records.select(id_col, text_col, *keep)).select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("_text"), *keep)
    types = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for pdf in batches:
            pdf.insert(1, "n_tokens", [len(encode(t)) if t else 0 for t in pdf.pop("_text")])
            yield pdf

    return rows.mapInPandas(count, f"item_id bigint, n_tokens bigint{types}")

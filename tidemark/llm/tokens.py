"""Token sizes by a public tokenizer given as a rank file (tiktoken format); the path is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = os.environ.get("TIDEMARK_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: the pattern that splits text before the merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str = RANKS):
    """The tokenizer, once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("tidemark", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def byte_lengths(path: str = RANKS) -> np.ndarray:
    e = encoding(path)
    return np.array([len(e.decode_single_token_bytes(i)) for i in range(e.n_vocab)], np.int32)


def parts(text: str, size: int = 100_000) -> Iterator[str]:
    """The text in parts cut before a blank that follows a letter, where no token of the pattern can reach across.

    Only keeps the pattern's recursion short on very long texts; a stretch without such a place stays whole."""
    a = 0
    while len(text) - a > size:
        b = a + size
        while b < len(text) and not (text[b] == " " and text[b - 1].isalpha() and b + 1 < len(text) and text[b + 1].isalpha()):
            b += 1
        yield text[a:b]
        a = b
    yield text[a:]


def encode(text: str, path: str = RANKS) -> list[int]:
    text = text.encode("utf-8", "replace").decode()
    e = encoding(path)
    if len(text) <= 100_000:
        return e.encode_ordinary(text)
    return [t for p in parts(text) for t in e.encode_ordinary(p)]


def spread(df: DataFrame) -> DataFrame:
    """The same rows in more tasks, where a table has fewer splits than there are cores.

    Texts cost far more to work through than to move, and so few splits are little data; a larger table is left as it
    is read and not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def with_tokens(df: DataFrame, text: str, name: str = "tokens", path: str = RANKS, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` and the token count of the whole text (0 for null or empty); the text stays behind."""
    keep = keep or []
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + (", " if keep else "") + f"`{name}` long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            n = pa.array([len(encode(t, path)) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], n], [*keep, name])

    return spread(df.select(*keep, F.col(text))).mapInArrow(run, schema)

"""Sizes of documents in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the vocabulary's pre-tokenization pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY):
    """The vocabulary's encoder, loaded once a worker."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _rows(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(sizes, pa.int64())], names=[*rest, "tokens"])

    return run


def token_counts(documents: DataFrame, *columns: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, the named columns and ``tokens`` of every row; NULL and empty texts have 0 tokens."""
    rows = documents.select("doc_id", *columns, "text")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_rows(vocabulary), ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *columns)) + ", tokens bigint")


def numbered(sizes: DataFrame) -> DataFrame:
    """The rows with ``row``, a number of its own for each; to be written before it is relied on."""
    return sizes.withColumn("row", F.monotonically_increasing_id())

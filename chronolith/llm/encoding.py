"""Encoding a corpus with a public tokenizer (problem 7)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prefix_bpe import CHUNK_CHARS, PrefixEncoder, load_ranks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_encoders: dict[str, PrefixEncoder] = {}


def encoder_for(path: str) -> PrefixEncoder:
    """The worker's encoder; it and its remembered pieces serve all tasks of the worker."""
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(load_ranks(path))
    return _encoders[path]


def text_chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about CHUNK_CHARS characters; every row is in one."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_texts(documents: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text", counts_only: bool = False) -> DataFrame:
    """(id, ids) of every row, or (id, n_tokens) with ``counts_only``.

    A null and an empty text have an empty list of ids and 0 tokens.  Every row
    gives one row, also rows whose id is null or repeated.  Texts are whole;
    strings that look like special tokens are ordinary text.  Other columns are
    not read, whatever their names.  The work is one narrow pass without a
    shuffle; memory is bounded by the longest text and CHUNK_CHARS.
    """
    kind = documents.schema[id_column].dataType
    out = T.StructType([T.StructField(id_column, kind), T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in text_chunks(texts):
                ids, each = encoder.encode_many(texts[a:b])
                if counts_only:
                    made = pa.array(each, pa.int64())
                else:
                    ends = each.cumsum()
                    made = pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), made], [id_column, out[1].name])

    return documents.select(F.col(id_column), F.col(text_column).cast("string").alias(text_column)).mapInArrow(run, out)

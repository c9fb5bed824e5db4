"""Encoding texts with a public tokenizer, and counting their tokens."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe_stream
from .common import ship, tokenizer_dir


def vocabulary(name: str = "byte_bpe_50k") -> str:
    return os.path.join(tokenizer_dir(), f"{name}.json")


def encode_texts(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """(id, ids array<bigint>): the token ids of each row's text, without special tokens.

    One map over the rows, no shuffle; each text is streamed through a transducer of constant memory. Null and empty texts give an empty
    list, whatever the id; a null id stays null; repeated rows give repeated results, other columns are not read. Strings of special
    tokens inside a text are ordinary text."""
    ship(df.sparkSession)
    where = path or vocabulary()
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.LongType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe_stream.encoder(where).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [encode(t) if t else [] for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.empty(offsets[-1], np.int64)
                for x, a, b in zip(lists, offsets, offsets[1:]):
                    flat[a:b] = x
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), values], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, out)


def count_tokens(df: DataFrame, text_col: str, into: str = "n_tokens", path: str | None = None) -> DataFrame:
    """df without its text, with the number of tokens of the text (0 for null and empty texts) as a bigint in ``into``."""
    ship(df.sparkSession)
    where = path or vocabulary()
    others = [c for c in df.columns if c not in (text_col, into)]
    out = T.StructType([*(df.schema[c] for c in others), T.StructField(into, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = bpe_stream.encoder(where).count
        for batch in batches:
            n = [count(t) if t else 0 for t in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(n, pa.int64())], names=[*others, into])

    return df.select(*others, text_col).mapInArrow(run, out)


def decode_ids(df: DataFrame, id_col: str, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text): the text of each list of ids; an empty or null list gives an empty text."""
    ship(df.sparkSession)
    where = path or vocabulary()
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = bpe_stream.encoder(where).merges
        for batch in batches:
            texts = [bpe_stream.Decoder(merges).decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, F.col(ids_col)).mapInArrow(run, out)

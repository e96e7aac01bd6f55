"""Byte-level BPE encoding and decoding of a text column.

The merges of each pretoken run on a segment tree of pair ranks (see ``bpe``).  No shuffle; a task holds one Arrow
batch and a bounded memory of pretokens.

Defined cases: a null text is an empty text (no ids); a very long text is one row, and a pretoken of any length takes a logarithmic
number of steps a merge; repeated rows give repeated results; an empty table gives an
empty result; ties between equal ranks go to the leftmost pair; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sectorlake.llm import bpe
from sectorlake.llm.textcore import chunks


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<bigint>): the ids of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.from_ranks(ranks_path)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                ids, at = model.encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<bigint>")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, bytes binary): the bytes that the ids stand for; null ids give no bytes."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.from_ranks(ranks_path)
        for batch in batches:
            out = [model.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and return the number of ids and the digests of both."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.from_ranks(ranks_path)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                ids, at = model.encode(data, offsets)
                ids = ids.astype("<u4", copy=False)
                bounds = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                raw, begin = memoryview(model.decode(ids)), model.token_start[ids.astype(np.int64) + 1] - model.token_start[ids]
                cut = np.concatenate([[0], np.cumsum(begin)])[at].tolist()
                view = memoryview(ids).cast("B")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(at)),
                        pa.array([hashlib.sha256(view[4 * a : 4 * b]).hexdigest() for a, b in bounds]),
                        pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)

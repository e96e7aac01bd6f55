"""Packing by power-of-two decomposition.

A document of n ids is cut, in order, into pieces of ``max_length`` ids and then pieces of the binary digits of the
rest, largest first.  Each piece is a sequence of its own, so no sequence crosses documents and none is padded;
sequences of equal length share a bucket (``bucket`` = log2 of the length), which is what a trainer batches by: each task sorts its
sequences by bucket, so that those of one length follow each other, by their ids too, and ``write_buckets`` writes a folder for each.
No shuffle: a sequence's id is its partition and its place there.

Defined cases: a null text is an empty text and packs as the end id alone; a very long text is one row, its pieces many rows; an
empty table gives an empty result; repeated rows are packed once each; pieces of one length stand in any order; ids of rows are
passed on as they are, nulls included; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sectorlake.llm import bpe
from sectorlake.llm.textcore import chunks

MAX_LENGTH = 1024
END_ID = 0


def pieces(lengths: np.ndarray, max_length: int = MAX_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of every piece, in document order."""
    full, rest = lengths // max_length, lengths % max_length
    top = max_length.bit_length() - 1
    bits = (rest[:, None] >> np.arange(top - 1, -1, -1)) & 1
    count = full + bits.sum(1)
    doc = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    size = np.full(len(doc), max_length, np.int64)
    size[nth >= full[doc]] = np.broadcast_to(1 << np.arange(top - 1, -1, -1), bits.shape)[bits.astype(bool)]
    ends = np.cumsum(size)
    return doc, ends - size - np.repeat(np.cumsum(lengths) - lengths, count), size


def pack(docs: DataFrame, tokenizer_path: str, max_length: int = MAX_LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves as ``ids array<int>``."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.from_json(tokenizer_path)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                ids, at = model.encode(data, offsets)
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                total = np.diff(at) + 1
                doc, start, size = pieces(total, max_length)
                end = np.cumsum(size)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((end - size).tolist(), end.tolist(), strict=True)]
                cols = [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), *map(pa.array, (start, size, np.array(crc, np.int64), total[doc], np.log2(size).astype(np.int32)))]
                names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "bucket"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, bucket int" + ", ids array<int>" * with_ids
    packed = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
    return packed.sortWithinPartitions(F.desc("bucket")).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the pieces as one folder for each bucket, so that a reader gets batches of one length."""
    packed.write.mode("overwrite").partitionBy("bucket").parquet(path)

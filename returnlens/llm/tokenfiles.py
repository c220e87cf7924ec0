"""Token ids as Parquet files that can be read selectively.

Documents are put in ascending doc_id order (ranges over tasks, sorted inside),
encoded, and written as one list column of ids beside small metadata columns:

* ``ids`` is dictionary-encoded (bit-packed indexes), the integer metadata is
  delta-encoded (Parquet 2 pages), so both stay small;
* row groups are cut at ``row_group_bytes``, pages at ``page_bytes`` and
  ``page_rows`` rows, and Parquet's column and offset indexes are written, so a
  reader that wants a doc_id range or only the metadata skips the rest;
* ``part`` and ``part_start`` give each document's place: the ids of the parts
  before its own, then ``part_start``.

Edge cases: a null or empty text has only the end id; repeated doc_ids are
ordered by their text's hash; null doc_ids come first, as Spark sorts them; an
empty table writes a file without rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_path

FILE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()),
    T.StructField("part_start", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character:
    bytes that print stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class JsonEncoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file.

    The library's ids are also those of the rank algorithm whenever ids follow
    the order of merges; the file is checked for that, and texts without a
    special string then take the faster rank encoder.  All others go through
    the library itself."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        vocab, byte = spec["model"]["vocab"], _byte_of_char()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab.get(a + b, -1) for a, b in pairs]
        ranked = made == list(range(256, 256 + len(made))) and (spec["pre_tokenizer"] or {}).get("use_regex", False) \
            and not spec["normalizer"]
        self.fast = None
        if ranked:
            ranks = {bytes(byte[c] for c in w): i for w, i in vocab.items() if w not in set(self.special)}
            self.fast = tiktoken.Encoding("json", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        return np.array(self.fast.encode_ordinary(text), np.int32)


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> JsonEncoder:
    return JsonEncoder(path, pattern)


def write_token_files(docs: DataFrame, path: str, pattern: str, end_id: int = 0, out: str | None = None,
                      row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2_000) -> str:
    """Encode (doc_id, text) rows and write the files; returns their folder."""
    spark = docs.sparkSession
    out = out or shared_path(spark, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(path, pattern), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.int32)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                ids = [np.append(enc.encode(t.as_py() or ""), end) for t in batch.column(1)[lo:lo + 256]]
                sizes = np.array([len(x) for x in ids], np.int64)
                ends = np.cumsum(sizes)
                flat = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:lo + 256], pa.array(np.full(len(ids), part, np.int32)),
                     pa.array(start + ends - sizes), pa.array(sizes), flat], names=FILE_SCHEMA.names)
                start += int(ends[-1])

    ordered = (docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text")
               .repartitionByRange("doc_id", F.xxhash64("text"))
               .sortWithinPartitions("doc_id", F.xxhash64("text")))
    (ordered.mapInArrow(run, FILE_SCHEMA).write
     .option("parquet.block.size", str(row_group_bytes))
     .option("parquet.page.size", str(page_bytes))
     .option("parquet.page.row.count.limit", str(page_rows))
     .option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.enable.dictionary", "true")
     .option("parquet.enable.dictionary#doc_id", "false")
     .option("parquet.enable.dictionary#part_start", "false")
     .option("parquet.enable.dictionary#n_tokens", "false")
     .parquet(out))
    return out


def read_token_files(spark, folder: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(folder)


def placed(files: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all documents before.  The totals of the
    parts (one row for each written file, no more than the listing that the
    reader's planner holds) are summed up on the driver."""
    spark = files.sparkSession
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, rows = 0, []
    for r in totals:
        rows.append((r.part, before))
        before += r.n
    offsets = spark.createDataFrame(rows, "part int, part_offset bigint")
    return files.join(offsets, "part").withColumn("start", F.col("part_offset") + F.col("part_start"))


def checksums(files: DataFrame) -> DataFrame:
    """(doc_id, part, part_start, n_tokens, ids_crc32) from the files' ids:
    unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    schema = T.StructType([*FILE_SCHEMA.fields[:4], T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))
            ends = ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], names=schema.names)

    return files.mapInArrow(run, schema)

"""The corpus pipeline: toxic documents go, near-duplicates go, sources are
mixed to their weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, the
rows that the stage before kept.  All but the last return the columns of
``documents``.  ``run`` writes each stage's rows as Parquet in the shared folder
and reads them again, so a lost executor repeats one stage's tasks at most.

Edge cases are those of the operators: null and empty texts stay (they are one
near-duplicate group), repeated rows are one group, an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from returnlens.llm import bpe, mixing, simhash, toxicity
from returnlens.llm.common import on_workers, stored
from returnlens.llm.queries import bpe_digests
from returnlens.sources.tables import table


@on_workers
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is not rejected."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", ["doc_id", "toxic"]), sample_each=4_000)
    return toxicity.keep_clean(docs, model)


@on_workers
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that of the smallest doc_id."""
    return simhash.deduplicated(docs, shingle=3, max_bits=3)


@on_workers
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs, weights=[5, 2, 1], share=1.0, cap=3.0)


@on_workers
def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with their digest and that of the decoded text."""
    encoded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe_digests(encoded)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL expresses neither the fits nor the components; tests compare with brute force.
ORACLE_SQL = None


@on_workers
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

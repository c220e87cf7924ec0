"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, materialize
from ..sources.tables import table


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the shared folder the cluster names."""
    return os.path.join(ensure_checkpoint_dir(spark), "llm", f"{kind}-{uuid.uuid4().hex}")


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: the plan
    runs once, later jobs and retries read the files."""
    return materialize(df, os.path.join("llm", kind))


def on_workers(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query`` (spark, ...) with this package's folder on the Python path of
    the workers, where it is not installed there."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        env = spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if home not in paths:
            env["PYTHONPATH"] = os.pathsep.join([home, *paths])
        return query(spark, *args)

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", ["doc_id", "text"])


def unused(columns: list[str], *names: str) -> list[str]:
    """``names`` with as many underscores before them as no column of
    ``columns`` needs to differ from all (in any case)."""
    taken, mark = {c.lower() for c in columns}, "__"
    while any(mark + n.lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def rows_of(batch: pa.RecordBatch, column: int, chars: int = 1 << 20):
    """Start and texts of consecutive pieces of a batch's string column, each
    of about ``chars`` characters (at least one row); a null text is empty."""
    texts, start, held = [], 0, 0
    for text in batch.column(column):
        texts.append(text.as_py() or "")
        held += len(texts[-1])
        if held >= chars:
            yield start, texts
            start, texts, held = start + len(texts), [], 0
    if texts:
        yield start, texts

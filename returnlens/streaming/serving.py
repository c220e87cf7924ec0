"""SC13 on X2: fitted models on a stream, reloaded as they are published.

A store is a folder with a table of versions and a saved model (IO3) for each.
Every micro-batch looks up the newest version when it starts, loads its model if
it is not the one at hand, and writes its rows, tagged with the version that
scored them, to a folder of its own.  A batch that is run again after a failure
replaces that folder, so each row is written once and by one version.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models as ML
from ..session import scratch_path

VERSIONS = "version int, folder string"


def publish(spark: SparkSession, store: str, model: ML.FittedModel) -> int:
    """Adds ``model`` to the store; returns its version.  The row is written
    after the model, so a version that is listed can be loaded.  One publisher
    at a time."""
    version = (newest(spark, store) or (0, ""))[0] + 1
    folder = os.path.join(store, f"model-{version}")
    ML.save(model, folder)
    spark.createDataFrame([(version, folder)], VERSIONS).coalesce(1).write.mode("append").parquet(os.path.join(store, "versions"))
    return version


def newest(spark: SparkSession, store: str) -> tuple[int, str] | None:
    """(version, folder) of the newest model; None while there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(store, "versions"))
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    row = spark.read.schema(VERSIONS).parquet(os.path.join(store, "versions")).orderBy(F.desc("version")).first()    # one row
    return tuple(row) if row else None


def serve(stream: DataFrame, store: str, out: str, checkpoint: str) -> None:
    """Scores what has arrived on ``stream`` with the models of ``store`` and
    goes on from ``checkpoint`` when called again.  Without a model it is an error."""
    if not stream.isStreaming:
        raise ValueError("serve expects a streaming DataFrame")
    held: dict[int, ML.FittedModel] = {}

    def score(batch: DataFrame, number: int) -> None:
        found = newest(batch.sparkSession, store)
        if found is None:
            raise RuntimeError(f"no model has been published in {store}")
        version, folder = found
        if version not in held:
            held.clear()
            held[version] = ML.load(folder)
        held[version].score(batch).withColumn("version", F.lit(version)).write.mode("overwrite").parquet(os.path.join(out, f"batch={number}"))

    stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def served(spark: SparkSession, out: str) -> DataFrame:
    """All rows that ``serve`` has written, with their version and batch."""
    return spark.read.parquet(out)


def reloaded_scores(lines: DataFrame, slices: list[tuple[DataFrame, ML.FittedModel]]) -> DataFrame:
    """Each of ``slices`` lands after its model has been published: the rows as
    the stream has scored them."""
    from .stream import land, lines_stream
    spark = lines.sparkSession
    home = scratch_path(spark, "serving")
    store, landing, out = (os.path.join(home, x) for x in ("models", "landing", "out"))
    for rows, model in slices:
        publish(spark, store, model)
        land(rows, landing)
        serve(lines_stream(spark, landing, lines.schema), store, out, os.path.join(home, "checkpoint"))
    return served(spark, out)

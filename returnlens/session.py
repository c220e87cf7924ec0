"""Spark session helpers.

The library never creates its own cluster settings on a real cluster: it reads
what the session carries and only fills in values that are unset (tests,
local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "returnlens") -> SparkSession:
    """A local session for tests and the benchmark.

    Shuffle partitions are sized to the core count (not the default 200), AQE
    coalesces small shuffles and splits skewed join partitions, and the UI is
    off.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("RETURNLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset
    on a local master (tests) is a scratch folder created and registered.  On
    a cluster a folder of the driver's machine would lose data: an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="returnlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


#: Folders handed out by ``scratch_path`` that ``release`` has not deleted yet.
_STORED: list[str] = []


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the shared checkpoint folder, which ``release``
    deletes too."""
    import uuid
    path = os.path.join(ensure_checkpoint_dir(spark), kind, uuid.uuid4().hex)
    _STORED.append(path)
    return path


def materialize(df, kind: str = "tables"):
    """Write ``df`` as a Parquet table in the shared checkpoint folder and
    return a frame that reads it back.  The plan runs once; the table
    survives executor loss and cuts the lineage, so later jobs read it
    (with column pruning and pushed filters) instead of recomputing the
    plan that produced it.  ``release`` deletes such tables."""
    spark = df.sparkSession
    path = scratch_path(spark, kind)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` has written so far, once the
    frames read from them are no longer needed; returns their number."""
    jvm, n = spark.sparkContext._jvm, len(_STORED)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _STORED:
        path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        path.getFileSystem(conf).delete(path, True)
    return n

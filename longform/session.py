"""Spark session helpers.

The checkpoint folder is read from ``spark.checkpoint.dir`` as the cluster names it; a fresh folder is
only made when the setting is missing and Spark runs in local mode (tests, laptops).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


# Tables of a story run are dealt by story: a join on a story and more columns may use that dealing, cached views keep the
# one they were given, and step files (nested texts, highly compressed) count with the size that they have once read.
STORY_CONF = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "false",
    "spark.sql.sources.fileCompressionFactor": "10",
}


def story_session(spark: SparkSession) -> None:
    for k, v in STORY_CONF.items():
        spark.conf.set(k, v)


def plain_session(spark: SparkSession) -> None:
    """Takes back what ``story_session`` set, for queries on other tables in the same session."""
    for k, v in STORY_CONF.items():
        if spark.conf.get(k, None) == v:
            spark.conf.unset(k)


def get_spark(master: str | None = None, app: str = "longform", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", os.environ.get("LONGFORM_DRIVER_MEMORY", "16g"))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and stage tables.

    Uses ``spark.checkpoint.dir`` when the session has it. Only a local-mode session without the setting
    gets its own fresh folder, never a cluster.
    """
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="longform-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder for stage tables written between rounds."""
    base = checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "longform", *parts])


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: for rows that a plan reads several times and that are dear to derive."""
    spark = df.sparkSession
    path = scratch_path(spark, f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

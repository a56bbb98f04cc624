"""The Spark session, and the shared folder for written intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Catalyst and AQE do the planning; these only make sure nothing is switched off.
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # JSON with a key twice is valid; the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("evenkeel")
    if master:
        builder = builder.master(master)
    for k, v in {**CONF, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is only made for a local master, where this machine is
    the whole cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evenkeel-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder nothing has been written to."""
    return f"{shared_folder(spark).rstrip('/')}/evenkeel/{name}-{uuid.uuid4().hex}"


def forget(frame: DataFrame) -> None:
    """Delete the folders below the shared one that a written frame reads."""
    spark = frame.sparkSession
    inside = f"{shared_folder(spark).rstrip('/')}/evenkeel/".removeprefix("file://").removeprefix("file:")
    folders = {f.rsplit("/", 1)[0] for f in frame.inputFiles()}
    for folder in folders:
        if inside in folder.replace("file://", "").replace("file:", ""):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

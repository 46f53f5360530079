"""Session settings and the shared staging folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings a cluster session should carry. None of them sizes anything by the
# local machine: AQE picks the number of shuffle partitions at run time.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "ledgerlight", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder; a
    cluster session without it is refused, since executors could not share it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="ledgerlight-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/ledgerlight/{app}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where several later passes need the same rows: the source is scanned
    once, lost executors cost nothing but their own tasks, and the file sizes
    give the optimizer real statistics.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    scope = getattr(_scopes, "paths", None)
    if scope is not None:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_scopes = threading.local()


@contextmanager
def collected_stages(paths: list[str]) -> Iterator[None]:
    """Note the folders that this thread stages inside in ``paths``."""
    outer = getattr(_scopes, "paths", None)
    _scopes.paths = paths
    try:
        yield
    finally:
        _scopes.paths = outer


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Remove what is staged inside at the end; no frame that reads it may be used after."""
    paths: list[str] = []
    try:
        with collected_stages(paths):
            yield
    finally:
        remove(spark, paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of any file system the session reads."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

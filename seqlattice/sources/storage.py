"""Cutting lineage: intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a folder of this machine will do for a local master; on a cluster each executor would
    write to a disk of its own, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir names no folder that the executors of {master!r} share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when it is whole, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table: what an executor's loss takes is read again, not computed again."""
    return written(df, "table")


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` or ``written`` gave and that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

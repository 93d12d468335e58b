"""Versions of a set of tables in one folder: written aside, published in one step, and only on the version they came from.

``CURRENT`` names the folder that holds.  A version's name is a hash of its rows, so it says what is in it.  Publishing on
a base makes a marker that exists once for each base: of two writers that read the same version one is refused, whatever
the order of their steps.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CURRENT = "CURRENT"
_LANES = 8


class StaleBaseError(ValueError):
    """The version that a change was made for isn't the current one."""


def table_hash(df: DataFrame) -> str:
    """A hash of all rows and columns, whatever the rows' order: sums of each row's SHA-256, by 32 bits."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    lanes = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"l{i}") for i in range(_LANES)]
    sums = df.select(row.alias("h")).agg(F.count("*").alias("n"), *lanes).first()
    text = ",".join([*sorted(df.columns), str(sums.n), *(str(int(sums[f"l{i}"] or 0) % (1 << 32)) for i in range(_LANES))])
    return hashlib.sha256(text.encode()).hexdigest()


def version_of(tables: dict[str, DataFrame]) -> str:
    return hashlib.sha256(",".join(f"{name}={table_hash(df)}" for name, df in sorted(tables.items())).encode()).hexdigest()


def _files(spark: SparkSession, root: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return jvm, path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> str | None:
    """The name of the version that holds; None before the first."""
    jvm, path, fs = _files(spark, root)
    file = jvm.org.apache.hadoop.fs.Path(path, _CURRENT)
    if not fs.exists(file):
        return None
    stream = fs.open(file)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version that holds now."""
    return spark.read.parquet(f"{root}/{current(spark, root)}/{name}")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], base: str | None) -> str:
    """Make ``tables`` the current version if ``base`` still is; the new version's name.

    The tables are written to a folder of their own first; the pointer is then replaced by a rename, so readers see the
    old or the new version.  A failure leaves the old version, and takes back the marker.
    """
    jvm, path, fs = _files(spark, root)
    at = lambda name: jvm.org.apache.hadoop.fs.Path(path, name)
    if current(spark, root) != base:
        raise StaleBaseError(f"{root} is at {current(spark, root)}, not at {base}")
    staged = f"staged-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{staged}/{name}")
    version = version_of({name: spark.read.schema(df.schema).parquet(f"{root}/{staged}/{name}") for name, df in tables.items()})
    if version == base:
        fs.delete(at(staged), True)
        return version
    fs.mkdirs(path)
    marker = at(f"after-{base}")
    if not fs.createNewFile(marker):
        fs.delete(at(staged), True)
        raise StaleBaseError(f"another change of {base} was published")
    try:
        if current(spark, root) != base:
            raise StaleBaseError(f"{root} is no longer at {base}")
        if fs.exists(at(version)):
            fs.delete(at(staged), True)
        else:
            fs.rename(at(staged), at(version))
        pointer = at(f"pointer-{uuid.uuid4().hex}")
        stream = fs.create(pointer, True)
        stream.write(bytearray(version.encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
        overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(pointer, at(_CURRENT), overwrite)
    except Exception:
        fs.delete(marker, False)
        raise
    fs.delete(at(f"after-{version}"), False)  # a version that holds again may be changed again
    return version

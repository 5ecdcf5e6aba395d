"""Tables that a session keeps in the folder that all executors share."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one is made in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="quillstone-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared(spark)}/quillstone-{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once below the shared folder, for what reads them more than once."""
    where = scratch(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def stamp(df: DataFrame) -> str:
    """A digest of the files that a table is read from: their paths, sizes and times."""
    seen = hashlib.sha1()
    for f in sorted(df.inputFiles()):
        fs, p = _files(df.sparkSession, f)
        s = fs.getFileStatus(p)
        seen.update(f"{f} {s.getLen()} {s.getModificationTime()}\n".encode())
    return seen.hexdigest()


def swap(spark: SparkSession, building: str, path: str) -> None:
    """Put a folder that is written in full in the place of another one, which goes."""
    fs, new = _files(spark, building)
    _, old = _files(spark, path)
    if fs.exists(old):
        fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{building} can't be renamed")


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file."""
    fs, p = _files(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()

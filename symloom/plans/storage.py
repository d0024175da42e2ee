"""Written tables between the rounds of iterative plans, in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder that the session has. Only on one machine (tests) a temporary folder
    is made where neither is set; a cluster has to name a folder that all its machines see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="symloom-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df and reads it again: the lineage ends here, and lost executors lose nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a small file below a temporary name and renames it."""
    jvm = spark.sparkContext._jvm
    target, temporary = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(temporary)
    out.write(bytearray(data))
    out.close()
    fs.rename(temporary, target)

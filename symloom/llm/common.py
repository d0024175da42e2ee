"""What the training-data operators share: the shared folder, written tables, code shipping, column names."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom import session
from symloom.plans.storage import folder

#: White space of all word and line contracts: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of one Arrow batch between Spark and Python, and of the row groups that a task's Parquet writer holds.
BATCH_BYTES, GROUP_BYTES = 1 << 23, 1 << 25
_held: dict[str, Callable[[], None]] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, and keeps Arrow batches of whole texts small."""
    session.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def hold(owner: str, clear: Callable[[], None]) -> None:
    """Tells that owner keeps tables in this Python worker between tasks, and how to drop them."""
    _held[owner] = clear


def begin(owner: str = "") -> None:
    """Called by a Python task of owner: what other owners' tasks left in this reused worker goes, and freed memory goes
    back to the system."""
    others = [k for k in _held if k != owner]
    if not others:
        return
    for k in others:
        _held.pop(k)()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors see."""
    base = folder(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts the lineage, survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, label)
    df.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path that this library wrote."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def long_hash(c: Column, seed: int = 0) -> Column:
    """A 64-bit hash; different seeds give independent ones."""
    return F.xxhash64(F.lit(seed), c)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name

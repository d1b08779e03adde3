"""Shared storage for intermediate tables: lineage is cut by tables that every executor can read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_before.get() if set_before.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._stored_at = path
    return made


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``stored`` that no returned plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Slots of 64 bits of a filter of keys, so what is broadcast has this bound at every size.
SLOTS = 1 << 18


def perhaps_in(df: DataFrame, wanted: DataFrame, key: str, *, inside: bool = True) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among those of ``wanted``: all that are, and few others. An exact join follows.
    Not ``inside``: the other rows, none of which is among them."""
    h = F.xxhash64(key)
    slot, bit = F.pmod(F.shiftright(h, 6), F.lit(SLOTS)), h.bitwiseAND(F.lit(63)).cast("int")
    bits = wanted.select(slot.alias("_slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    met = df.join(F.broadcast(bits), slot == F.col("_slot"), "inner" if inside else "left")
    return met.where(F.coalesce(F.getbit("_bits", bit), F.lit(0)) == (1 if inside else 0)).select(*df.columns)


#: Bytes a core below which a table's rows are dealt out anew, as its files give fewer tasks than there are cores.
SMALL = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt out to all cores if the table is small (a single row group is a single task); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < SMALL * cores else df

"""What the operators of this subpackage share: table access, shared storage, Arrow batches, null rules.

Common rules: a null text counts as the empty text; a null id stays null and never joins by accident (joins on ids are
null-safe where a row must find itself again); columns that an operator does not name are ignored, so extra columns
cannot clash with the operator's own.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.storage import spread

#: White space that parts words everywhere in this subpackage: space and the control characters 9 to 13.
WORD_GAP = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
#: Column that names a row's text while an operator works on it.
COPY = "_tessella_copy"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that any Spark file system understands; a small one is dealt out to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a temporary one only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, sizes are known to the planner.

    The files survive lost executors. They stay until the shared folder is cleared, as a returned plan may read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._stored_at = path
    return made


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables made by ``materialize`` that no returned plan reads: later tables have replaced them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def row_copy(text: Column) -> Column:
    """A 64-bit hash of a row's whole text. With the id it names a row; rows that agree in both are copies of each other."""
    return F.xxhash64(text)


#: Slots of 64 bits of a row filter: 16 million bits, so what is broadcast has this bound at every size.
SLOTS = 1 << 18


def row_filter(verdicts: DataFrame) -> DataFrame:
    """(slot, bits) over the ``v_copy`` of some rows: at most ``SLOTS`` rows, stored. A row that is not in it is not among them."""
    slot = F.pmod(F.shiftright("v_copy", 6), F.lit(SLOTS)).alias("slot")
    return materialize(verdicts.select(slot, F.expr("shiftleft(1L, cast(v_copy & 63 as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")), "row-filter")


def in_filter(df: DataFrame, bits: DataFrame, *, inside: bool) -> DataFrame:
    """The rows (with ``COPY``) that may be among the filter's, or those that cannot be. The larger the share of rows in the
    filter, the more of the others it lets pass as well; what may be in is to be settled by an exact join."""
    b = bits.select(F.col("slot").alias("_tessella_slot"), F.col("bits").alias("_tessella_bits"))
    met = df.join(F.broadcast(b), F.pmod(F.shiftright(COPY, 6), F.lit(SLOTS)) == F.col("_tessella_slot"), "left")
    hit = F.coalesce(F.expr(f"getbit(_tessella_bits, cast({COPY} & 63 as int))"), F.lit(0)) == 1
    return met.where(hit if inside else ~hit).select(*df.columns)


def same_row(df: DataFrame, other: DataFrame) -> Column:
    """Null-safe match of a row (``doc_id``, ``COPY``) with a verdict (``v_id``, ``v_copy``)."""
    return df["doc_id"].eqNullSafe(other["v_id"]) & (df[COPY] == other["v_copy"])


def words(text: Column) -> Column:
    """Array of words of a text column; null and blank texts have none. Runs in the JVM."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def map_arrow(df: DataFrame, fn: Callable, schema: str, stream: bool = False) -> DataFrame:
    """Apply ``fn`` to each Arrow batch (it returns a batch or a list of them), one batch in memory at a time; with
    ``stream``, ``fn`` gets the iterator of a partition's batches and yields batches."""

    # workers import this package: its folder joins their path, where that folder exists for them
    root, env = str(Path(__file__).resolve().parents[2]), df.sparkSession.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if stream:
            yield from fn(batches)
        else:
            for batch in batches:
                if batch.num_rows:
                    out = fn(batch)
                    yield from out if isinstance(out, list) else [out]
                    del batch, out
        give_back_memory()

    return df.mapInArrow(run, schema)


def give_back_memory() -> None:
    """At the end of a partition: what Arrow and the C library hold free goes back, as workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def one_blas_thread() -> Iterator[None]:
    """numpy's bundled OpenBLAS on one thread: many small products otherwise fight for cores that Spark has dealt out."""
    import numpy as np

    put, old = None, 0
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        lib = ctypes.CDLL(str(path))
        for suffix in ("64_", ""):
            if hasattr(lib, f"scipy_openblas_set_num_threads{suffix}"):
                put, old = getattr(lib, f"scipy_openblas_set_num_threads{suffix}"), getattr(lib, f"scipy_openblas_get_num_threads{suffix}")()
    if put:
        put(1)
    try:
        yield
    finally:
        if put:
            put(old)


def byte_chunks(batch: pa.RecordBatch, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most`` bytes each (a single longer row stays whole)."""
    rows = batch.num_rows
    size = max(batch.nbytes, 1)
    step = max(1, min(rows, int(rows * most / size)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def is_held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is a multiple of 10; a null id counts as the empty text, which is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0

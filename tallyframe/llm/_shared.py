"""Helpers that several text operators use."""

from __future__ import annotations

import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: What [\x20\x09-\x0D] holds.
BLANKS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is ``spark.checkpoint.dir`` where the cluster names one. Where it is unset, a local session
    (tests) gets a temporary folder, any other the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if sc.master.startswith("local[") or sc.master == "local":
            root = tempfile.mkdtemp(prefix="spark-tallyframe-")
        else:
            root = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read of finished files, never a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tallyframe-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else; the plain function serves where a text is all ASCII."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def share(spark: SparkSession, value):
    """Broadcast an object of bounded size by value, so that executors need not have its module."""
    out = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    release()  # of the copies made on the way
    return out


def shared(broadcast):
    return pickle.loads(broadcast.value)


def share_arrays(spark: SparkSession, value):
    """Like ``share``, for objects made of large arrays: a worker reads them in place (see ``shared_arrays``), and the driver makes no copy."""
    buffers: list[pickle.PickleBuffer] = []
    head = cloudpickle.dumps(value, protocol=5, buffer_callback=buffers.append)
    return spark.sparkContext.broadcast((head, [pickle.PickleBuffer(b.raw().toreadonly()) for b in buffers]))


def shared_arrays(broadcast):
    """The object; its arrays are read-only views of what the worker holds of the broadcast, not copies beside that."""
    head, buffers = broadcast.value
    return pickle.loads(head, buffers=buffers)


def sized(rows, size, limit: int):
    """Cut an iterable into lists whose summed ``size`` stays near ``limit``; one large row stands alone."""
    out, total = [], 0
    for row in rows:
        n = size(row)
        if out and total + n > limit:
            yield out
            out, total = [], 0
        out.append(row)
        total += n
    if out:
        yield out


def rows_of(batch, columns: int, step: int = 128):
    """The rows of an Arrow batch as tuples of Python values, a slice at a time, so that no batch stands in memory twice."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield from zip(*(part.column(c).to_pylist() for c in range(columns)), strict=True)


def release() -> None:
    """Give what Arrow and the C library no longer use back to the system; workers live on after a task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU library has it
        trim(0)

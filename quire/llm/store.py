"""Tables and files in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: a lost executor then costs only the tasks it
ran, and no step is computed twice.  When the setting is absent, a local default is set if the master is local (tests, one
machine); on a cluster that is an error, since executors do not see each other's disks.
"""

from __future__ import annotations

import atexit
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_LOCAL_DEFAULT = "file:///tmp/checkpoints"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the shared checkpoint folder; it goes when the driver ends."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = _LOCAL_DEFAULT
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/quire-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a shared folder through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _made:
        try:
            drop(spark, path)
        except Exception:  # the JVM may be gone already
            return


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_fields(schema: T.StructType, ddl: str) -> T.StructType:
    """``schema`` followed by the columns of a DDL string."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def trim() -> None:
    """Give freed memory back to the system; a task does so at its end, since idle Python workers stay."""
    import ctypes
    import ctypes.util

    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(found := ctypes.CDLL(libc), "malloc_trim"):
        found.malloc_trim(0)


def slices(column: pa.Array, max_bytes: int = 1 << 20):
    """Row ranges of a string column of at most ``max_bytes`` of text each; a longer text stands alone."""
    import numpy as np

    n = len(column)
    if not n:
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield lo, hi
        lo = hi

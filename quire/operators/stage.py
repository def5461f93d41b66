"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import ValidationError

_made: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path below ``spark.checkpoint.dir``, removed when the driver ends unless it is to ``keep``; unset, it gets a default on a local master and is an error on a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValidationError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"
    if not keep:
        _made.append((spark, path))
    return path


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once and read back, so that costly parsing is not repeated by every plan that uses it."""
    path = shared_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may be gone already
            return

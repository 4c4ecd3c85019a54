"""Lineage cuts that survive the loss of executors.

Iterative jobs write each state to Parquet in the shared folder that the
cluster names in ``spark.checkpoint.dir`` and read it back. A later read needs
neither the executors that wrote it nor the plan that made it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, a temporary one of this process if all runs in it, else an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN[app] = "file://" + own
    return _OWN[app]


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Writes intermediate tables; ``drop`` deletes those no plan needs any more, ``close`` all of them once results are written."""

    def __init__(self, spark: SparkSession, name: str = "t"):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n:05d}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._graphloom_scratch = self  # keeps the id from being reused
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = self._paths.pop(id(df), None) if df is not None else None
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)

    def close(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self._paths.clear()

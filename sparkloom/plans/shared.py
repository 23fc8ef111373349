"""Intermediate tables in the shared scratch folder.

Iterative operators write a round's table as Parquet under ``spark.checkpoint.dir`` and read it back: the
lineage ends there, the data survive the loss of any executor, and a later round reads only the columns
it needs. The folder is the cluster's. Only a session in one process (master ``local``) may name none: it gets a folder
of its own. Anywhere else that is an error, for executors would write to disks that the others cannot read.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if master.partition("[")[0] != "local":
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        root = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """One operator run's tables. ``keep`` writes one; ``drop`` deletes it once a later one replaces it.

    What a returned DataFrame still reads stays until the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.kept: dict[int, tuple[DataFrame, str]] = {}  # the DataFrame is held, so that its id stays its own
        self.n = 0
        atexit.register(self._at_exit)

    def _at_exit(self) -> None:
        try:
            remove(self.spark, self.base)
        except Exception:
            pass  # the JVM may be gone already

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:04d}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept[id(out)] = (out, path)
        self.spark.sparkContext._jvm.System.gc()  # Spark deletes the shuffle files of plans that are gone
        return out

    def drop(self, df: DataFrame | None) -> None:
        held = self.kept.pop(id(df), None)
        if held:
            remove(self.spark, held[1])

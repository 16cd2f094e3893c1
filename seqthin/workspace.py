"""Intermediate tables in the folder the cluster shares.

Iterative steps cut their lineage by writing a Parquet table and reading it
back: the table outlives any executor, carries size statistics the optimizer
uses to choose join strategies, and keeps plans short.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
#: Names the folder in a session that is running already and has no such setting.
OWN_CONF = "seqthin.shared.dir"


def named_root(spark: SparkSession) -> str | None:
    """The folder the session names, if any."""
    core = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    root = core or spark.conf.get(OWN_CONF, None)
    return root.rstrip("/") if root else None


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables."""
    root = named_root(spark)
    if not root:
        raise RuntimeError(f"set {_CONF} or {OWN_CONF} to a folder all executors share")
    return root


@dataclass
class Phase:
    """One written table of a run."""

    name: str
    seconds: float
    seen: Observation

    @property
    def rows(self) -> int:
        return self.seen.get["rows"]


class Workspace:
    """A private subfolder of the shared folder, holding one run's tables.

    A ``measured`` one notes the rows and the time of every table, as the write itself
    observes them.
    """

    def __init__(self, spark: SparkSession, measured: bool = False):
        self.spark, self.measured = spark, measured
        self.phases: list[Phase] = []
        self.path = f"{shared_root(spark)}/seqthin-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[str, str] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads the written table."""
        self._n += 1
        path = self._paths[name] = f"{self.path}/{self._n:04d}-{name}"
        if self.measured:
            seen, start = Observation(), time.time()
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
            self.phases.append(Phase(name, time.time() - start, seen))
        else:
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete the table last written under ``name``, once nothing reads it any more."""
        self._delete(self._paths.pop(name))

    def release(self) -> None:
        """Delete this run's tables once no result reads them any more."""
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(target, True)

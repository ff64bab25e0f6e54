"""Written stages: tables of a long plan that are made once, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it gets a temporary folder, a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="pagelight-stages-"))
    return _own[0]


class Stages:
    """The stages of one run. `write` gives a table to read again as often as later stages need it: their plans begin there, and a lost executor costs
    its own tasks only. Without a `with` block the tables stay, for results that are read later."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.number = spark, f"{shared_folder(spark)}/stages/{name}-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.number += 1
        path = f"{self.path}/{self.number:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

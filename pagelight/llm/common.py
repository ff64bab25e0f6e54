"""What the operators share: the scratch folder all executors see, Arrow batches of texts, and helpers for columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frequent English words (fixed list): prose for training and for decoys.
COMMON_WORDS = "the of and to a in is it you that he was for on are with as his they be at one have this from or had by but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find".split()

_temporary: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session, as in tests, may go without: it gets a
    temporary folder. On a cluster every host would write a copy of its own, so there the setting is required."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _temporary:
        _temporary.append("file://" + tempfile.mkdtemp(prefix="pagelight-"))
    return _temporary[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/pagelight/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, so a lost executor
    costs its own tasks only, and later plans see the table's true size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """End Arrow batches of whole texts at 8 MB, however many rows that is: at Spark's default of 64 MB the batches of two tasks
    and their copies take most of a 3 GB executor. The setting is read when a query runs, so it is the session's; one that
    the session has made itself stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, "8m")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Spark's own file system, whatever store it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """The written tables of one run of an operator. All of them go when the `with` block ends, also after an error;
    what the operator returns is written by `materialize` before that."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.number = spark, scratch_path(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.number += 1
        path = f"{self.path}/{self.number:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this run before its end; nothing may read them afterwards."""
        for t in tables:
            for f in t.inputFiles()[:1]:
                remove(self.spark, f.rsplit("/", 1)[0])


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names for helper columns, as near to the wanted ones as columns that are there allow (case aside)."""
    seen, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column name for expressions, with dots and backticks taken literally."""
    return "`" + name.replace("`", "``") + "`"


def filtered(docs: DataFrame, run) -> DataFrame:
    """docs.mapInArrow(run) for a run that only leaves out rows; columns may have any names, as run sees them as c0, c1 and so on."""
    plain = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return plain.mapInArrow(run, plain.schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """A-Z to a-z and nothing else (lower() would also fold other scripts)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

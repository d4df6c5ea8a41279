"""What the operators of this subpackage share: tables, the shared folder, cut lineage, byte columns."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which a query's shuffle files go when the query ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Writes under way in all threads, and the setting's value before the first of them.
_SETTING, _WRITING = threading.Lock(), [0, None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the cluster's file system names it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().replace("file:/", "file:///", 1).replace("file://///", "file:///")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent a local folder serves on one machine; on a cluster that is an error.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="transcriba-")
    return qualified(spark, f"{top.rstrip('/')}/transcriba-{uuid.uuid4().hex}")


def materialise(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing.

    The write's shuffle files are deleted when it ends, as nothing reads them again.
    """
    path = shared_dir(spark)
    with _SETTING:
        _WRITING[0] += 1
        if _WRITING[0] == 1:
            _WRITING[1] = spark.conf.get(DROP_SHUFFLES, None)
            spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        with _SETTING:
            _WRITING[0] -= 1
            if _WRITING[0] == 0:
                if _WRITING[1] is None:
                    spark.conf.unset(DROP_SHUFFLES)
                else:
                    spark.conf.set(DROP_SHUFFLES, _WRITING[1])
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files behind materialised frames that nothing will read again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/transcriba-" in folder:
                p = jvm.org.apache.hadoop.fs.Path(folder)
                p.getFileSystem(conf).delete(p, True)


def fresh(docs: DataFrame, stem: str) -> str:
    """A column name that docs does not have: the stem, with underscores before it as needed."""
    taken = {c.lower() for c in docs.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def named(col: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{col.replace('`', '``')}`")


def columns(docs: DataFrame) -> list[Column]:
    """All columns of docs by their exact names."""
    return [named(c) for c in docs.columns]


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, by which a cluster is tuned to its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(named(col).cast("string"), F.lit("")).cast("binary").alias("content")

"""Sources: tables, media folders, checkpoints of JSON lines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_media


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; columns and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def media_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Path, size, checksum and title of the media files under a folder, by path; an error if it is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        raise NotADirectoryError(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(is_media(F.col("path")))
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1)
    files = files.orderBy("path")
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("checksum"), name.alias("title"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file of JSON lines; blank and broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def checkpoint_lines(spark: SparkSession, path: str, schema: str, broken: str = "broken_line") -> DataFrame:
    """Rows of JSON lines under a path, file and broken_line: the text of a line that is no row of the schema, null for rows.

    Blank lines give no row. So a count of broken_line by file says what was lost; rows alone are those where it is null.
    """
    rows = spark.read.schema(f"{schema}, {broken} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", broken).json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file"))


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array; an empty frame where the file is missing."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def work_folder(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent a local folder serves on one machine; on a cluster that is an error.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="transcriba-")
    return f"{top.rstrip('/')}/transcriba-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what several results need is made once, and a lost executor costs nothing."""
    path = f"{work_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

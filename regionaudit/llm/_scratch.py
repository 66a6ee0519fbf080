"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, as in tests, a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="regionaudit-"))
        atexit.register(__import__("shutil").rmtree, _own[0].removeprefix("file://"), True)
    return _own[0]


def new_path(spark: SparkSession) -> str:
    return f"{folder(spark)}/regionaudit-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: a lost executor costs no recomputation of what lies before."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a written table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(file)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)

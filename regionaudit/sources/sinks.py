"""Sinks: frame documents, summaries, split lists, anonymised exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_documents(masks: DataFrame, frame: str = "frame_id") -> DataFrame:
    """One nested record for each frame, ready for ``write.json`` or Parquet."""
    fields = [c for c in masks.columns if c != frame]
    return masks.groupBy(frame).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("masks"))


def summary(masks: DataFrame, decision: str = "triage") -> DataFrame:
    """Totals by class and decision, with a grand total where class_name is null."""
    return masks.rollup("class_name").agg(F.count("*").alias("masks"), *[F.count_if(F.col(decision) == d).alias(d) for d in ("accept", "reject", "human_review")])


def anonymised(df: DataFrame, pseudonyms: dict[str, str]) -> DataFrame:
    """Non-empty values of the given columns replaced; empty and null ones stay."""
    return df.withColumns({c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.lit(p)).otherwise(F.col(c)) for c, p in pseudonyms.items()})


def write_split_lists(df: DataFrame, path: str) -> None:
    """One text folder for each split, a line ``camera/<frame>.png`` for each frame."""
    df.select("split", F.concat(F.lit("camera/"), "frame_id", F.lit(".png")).alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def checksums(spark, path: str) -> DataFrame:
    """Path, length and SHA-256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))

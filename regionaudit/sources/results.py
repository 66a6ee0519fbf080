"""Sources: result documents, verification exports, lists, manifests, rasters, metric dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules

MASK = """struct<mask_id:int,class_id:int,class_name:string,bbox:array<int>,pixel_count:int,agents:struct<bbox:string,quality:string,consistency:string>,
 scores:struct<swin_agreement:double,lidar_support:double,swin_bypass:boolean,swin_q_threshold:double,swin_skip_threshold:double>,triage:string,
 parse_failed:map<string,struct<degenerate:boolean,raw:string>>,timing:struct<elapsed_seconds:double,agent_seconds:struct<bbox:double,quality:double,consistency:double>,vlm_calls:int>,
 metadata:struct<aspect_ratio:double,bbox_width:int,bbox_height:int>>""".replace("\n ", "")
CANDIDATE = "struct<swin_class:int,class_id:int,class_name:string,bbox_384:array<int>,bbox_orig:array<int>,pixel_count_384:int,vlm_response:string,confirmed:boolean,parse_failed:boolean,degenerate:boolean>"
RUN = "struct<model:string,timestamp:string,elapsed_seconds:double,n_masks:int,n_vlm_calls:int,vlm_health:struct<vlm_calls:bigint,degenerate_responses:bigint,degenerate_rate:double>>"
DOCUMENT = f"frame_id string, run_info {RUN}, masks array<{MASK}>, discovered array<{CANDIDATE}>, corrupt string"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Frame documents of a run; unreadable ones keep their text in ``corrupt``."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").option("pathGlobFilter", "frame_*.json").json(folder)


def usable(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("corrupt").isNull() & F.col("masks").isNotNull())


def masks(docs: DataFrame) -> DataFrame:
    """Silver table of masks, with their place in the frame."""
    return usable(docs).select("frame_id", F.posexplode("masks").alias("ordinal", "m")).select("frame_id", "ordinal", "m.*")


def candidates(docs: DataFrame) -> DataFrame:
    return usable(docs).select("frame_id", F.posexplode("discovered").alias("ordinal", "d")).select("frame_id", "ordinal", "d.*")


def export(spark: SparkSession, path: str) -> DataFrame:
    """A verification export, all columns strings; empty cells are null, and ``ord`` follows the order in the files."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "maskId" not in df.columns:
        raise ValueError("the export has no column maskId")
    df = df.select(*[F.when(F.col(c) != "", F.col(c)).alias(c.removeprefix("mask_")) for c in df.columns])
    return df.withColumn("ord", F.monotonically_increasing_id()).withColumn("frame_id", F.regexp_extract("frame", r"([^/]+?)(\.[^./]*)?$", 1))


def run_tags(df: DataFrame) -> list[str]:
    return sorted(c.removeprefix("triage_") for c in df.columns if c.startswith("triage_"))


def typed(text):
    """Booleans, integers and decimals of a cell, each in a field of its own; null where the cell is something else."""
    number = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.struct(F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true").alias("flag"), F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")).alias("whole"), F.when(number, text.try_cast("double")).alias("number"))


def frame_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_extract("value", r"([^/]+?)(\.[^./]*)?$", 1).alias("frame_id")).where("frame_id <> ''")


def weather(spark: SparkSession, path: str, frames: DataFrame | None = None) -> DataFrame:
    """Weather condition by frame from metadata documents; of ``frames`` (frame_id) those without a document are day_fair."""
    df = spark.read.schema("scraped_weather string, time_of_day string").option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    known = df.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("frame_id"), rules.weather(F.col("scraped_weather"), F.col("time_of_day")).alias("weather"))
    if frames is None:
        return known
    return frames.select("frame_id").join(known, "frame_id", "left").withColumn("weather", F.coalesce("weather", F.lit("day_fair")))


def rasters(spark: SparkSession, folder: str) -> DataFrame:
    """8-bit rasters with Spark's image source: frame_id, height, width, data."""
    df = spark.read.format("image").load(folder)
    return df.select(F.regexp_extract("image.origin", r"([^/]+?)\.[^./]*$", 1).alias("frame_id"), "image.height", "image.width", "image.data")


def metric_dump(spark: SparkSession, path: str) -> DataFrame:
    """Overlap, union and label counts by condition, frame and class."""
    frame = "struct<frame:string,overlap:array<bigint>,union:array<bigint>,label:array<bigint>>"
    df = spark.read.schema(f"eval_classes array<string>, conditions map<string,array<{frame}>>").option("multiLine", True).json(path)
    df = df.select("eval_classes", F.explode("conditions").alias("condition", "frames")).select("eval_classes", "condition", F.inline("frames"))
    zipped = F.arrays_zip(F.col("eval_classes").alias("class_name"), "overlap", "union", "label")
    return df.select("condition", "frame", F.inline(zipped).alias("class_name", "overlap", "union", "label"))


def incident(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("responses map<string,bigint>").option("multiLine", True).json(path).select(F.explode("responses").alias("raw", "n"))
    return df.withColumn("raw", F.when(F.col("raw") != "__NULL__", F.col("raw")))

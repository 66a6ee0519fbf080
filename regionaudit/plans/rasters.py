"""Raster queries on 8 by 8 frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as P
from ..operators.human import count_if
from ..session import ship
from ..sources.fixtures import PIXELS, pixels
from .registry import query


@query(f"WITH {PIXELS} SELECT frame, region, count(*) AS px, count(*) FILTER (dense = region) AS hits, count(*) FILTER (dense = region) / count(*) AS share FROM pixels WHERE region > 0 GROUP BY ALL")
def agreement_pixels(spark, sf_dir):
    return P.share_by_region(pixels(spark, sf_dir).where("region > 0"), F.col("dense") == F.col("region"), "frame", "region")


@query(f"WITH {PIXELS} SELECT frame, region, count(*) AS px, count(*) FILTER (lidar) AS hits, count(*) FILTER (lidar) / count(*) AS share FROM pixels WHERE region > 0 GROUP BY ALL")
def lidar_support_pixels(spark, sf_dir):
    return P.share_by_region(pixels(spark, sf_dir).where("region > 0"), F.col("lidar"), "frame", "region")


_COMPONENTS = f"""WITH RECURSIVE {PIXELS}, p AS (SELECT frame, region AS c, y * 8 + x AS pos, x, y FROM pixels WHERE region > 0),
 reach AS (SELECT frame, c, pos AS root, pos, x, y FROM p UNION SELECT r.frame, r.c, r.root, q.pos, q.x, q.y FROM reach r JOIN p q ON q.frame = r.frame AND q.c = r.c AND abs(q.x - r.x) <= 1 AND abs(q.y - r.y) <= 1),
 own AS (SELECT frame, c, pos, x, y, min(root) AS root FROM reach GROUP BY ALL)"""


@query(f"{_COMPONENTS} SELECT frame, c AS class_id, root::BIGINT AS component, count(*) AS px, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM own GROUP BY frame, c, root")
def components_8conn(spark, sf_dir):
    return P.components(pixels(ship(spark), sf_dir), "region", 8)


@query(f"WITH {PIXELS} SELECT frame, count(*) FILTER (dense > 0 AND region = 0) AS removed, count(*) FILTER (dense = 0 AND region > 0) AS added, count(*) FILTER (dense > 0 AND region > 0 AND dense <> region) AS changed FROM pixels GROUP BY frame")
def annotation_diff(spark, sf_dir):
    d, r = F.col("dense"), F.col("region")
    return pixels(spark, sf_dir).groupBy("frame").agg(count_if((d > 0) & (r == 0)).alias("removed"), count_if((d == 0) & (r > 0)).alias("added"), count_if((d > 0) & (r > 0) & (d != r)).alias("changed"))


@query()
def iou_greedy_match(spark, sf_dir):
    """Components of the class map, matched to stored components of the region map."""
    df = pixels(ship(spark), sf_dir)
    stored = P.components(df, "region", 8).withColumn("ordinal", F.row_number().over(_by_frame()).cast("int"))
    return P.greedy_match(P.components(df, "dense", 8), stored.drop("component"))


def _by_frame():
    from pyspark.sql import Window

    return Window.partitionBy("frame").orderBy("class_id", "component")

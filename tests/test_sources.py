"""Sources, sinks and column helpers on files and rows made here."""

import hashlib
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from regionaudit.functions import rules as R
from regionaudit.operators import raster, select, splits, stats
from regionaudit.sources import results, sinks

INCIDENT = {"??????????": 43784, "sign": 4907, "vehicle": 4481, "other": 1968, "pedestrian": 272, "cyclist": 218}


def gray_png(rows):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + chunk(b"IEND", b"")


def test_incident_file_scores(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"source_tag": "x", "frames": 4135, "responses": INCIDENT | {"__NULL__": 5}}, indent=1))
    df = results.incident(spark, str(tmp_path / "i.json"))
    assert df.where("raw IS NULL").first().n == 5
    bad, flagged = F.col("raw").rlike(r"^\?+$"), R.degenerate(F.col("raw"))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    got = df.where("raw IS NOT NULL").agg(n(bad & flagged), n(bad & ~flagged), n(~bad), n(~bad & flagged)).first()
    assert tuple(got) == (43784, 0, 11846, 0)


def test_weather_of_frames_with_and_without_documents(spark, tmp_path):
    cases = [("wind", "day", "day_fair"), ("fog", "day", "day_fair"), ("cloudy", "night", "day_fair"), ("clear-day", "night", "day_fair"), ("clear-night", "day", "night_fair"), ("rain", None, "day_rain"), ("rain", "night", "night_rain"), ("sleet", "night", "night_rain"), ("snow", "day", "snow"), ("", "day", "day_rain")]
    for i, (raw, time, _) in enumerate(cases):
        (tmp_path / f"{i:06d}").mkdir()
        (tmp_path / f"{i:06d}" / "metadata.json").write_text(json.dumps({"scraped_weather": raw} | ({"time_of_day": time} if time else {})))
    (tmp_path / "list.txt").write_text("".join(f"camera/frame_{i:06d}.png\n" for i in range(len(cases) + 1)))
    frames = results.frame_list(spark, str(tmp_path / "list.txt")).select(F.regexp_replace("frame_id", "^frame_", "").alias("frame_id"))
    got = {r.frame_id: r.weather for r in results.weather(spark, f"{tmp_path}/*/metadata.json", frames).collect()}
    assert got == {f"{i:06d}": w for i, (_, _, w) in enumerate(cases)} | {f"{len(cases):06d}": "day_fair"}


def test_rasters_and_metric_dump(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "frame_000007.png").write_bytes(gray_png([[0, 1, 2], [3, 4, 5]]))
    row = results.rasters(spark, str(tmp_path / "r")).first()
    assert (row.frame_id, row.height, row.width, list(row.data)) == ("frame_000007", 2, 3, [0, 1, 2, 3, 4, 5])
    dump = {"eval_classes": ["a", "b"], "conditions": {"day": [{"frame": "f1", "overlap": [1, 2], "union": [3, 4], "label": [5, 6]}], "night": []}}
    (tmp_path / "d.json").write_text(json.dumps(dump, indent=1))
    assert {tuple(r) for r in results.metric_dump(spark, str(tmp_path / "d.json")).collect()} == {("day", "f1", "a", 1, 3, 5), ("day", "f1", "b", 2, 4, 6)}


def test_export_cells_and_run_tags(spark, tmp_path):
    (tmp_path / "e.csv").write_text('frame,maskId,mask_triage_b,mask_triage_a,verdict,mask_bbox\ncamera/f_1.png,3,reject,,correct,"[1, 2]"\ncamera/f_1.png,4,accept,reject,,\n')
    df = results.export(spark, str(tmp_path / "e.csv"))
    assert results.run_tags(df) == ["a", "b"] and [r.triage_a for r in df.orderBy("ord").collect()] == [None, "reject"]
    (tmp_path / "bad.csv").write_text("frame\nx\n")
    with pytest.raises(ValueError, match="maskId"):
        results.export(spark, str(tmp_path / "bad.csv"))
    cells = ["true", "False", "12", "+5", ".5", "1_000", "1.5d", "-2e3", "text", None]
    got = [tuple(r.t) for r in spark.createDataFrame([(c,) for c in cells], "c string").select(results.typed(F.col("c")).alias("t")).collect()]
    none = (None, None, None)
    assert got == [(True, None, None), (False, None, None), (None, 12, 12.0), (None, 5, 5.0), (None, None, 0.5), none, none, (None, None, -2000.0), none, none]


def test_documents_come_back_as_they_were_written(spark, tmp_path):
    rows = [("frame_1", 0, "sign", "accept"), ("frame_1", 1, "vehicle", "reject"), ("frame_2", 0, "sign", "human_review")]
    masks = spark.createDataFrame(rows, "frame_id string, mask_id int, class_name string, triage string")
    sinks.frame_documents(masks).write.json(str(tmp_path / "docs"))
    back = spark.read.schema(results.DOCUMENT).json(str(tmp_path / "docs"))
    assert sorted((r.frame_id, r.mask_id, r.class_name, r.triage) for r in results.masks(back).collect()) == rows
    got = {r.class_name: tuple(r)[1:] for r in sinks.summary(masks).collect()}
    assert got == {None: (3, 1, 1, 1), "sign": (2, 1, 0, 1), "vehicle": (1, 0, 1, 0)}


def test_split_lists_and_checksums(spark, tmp_path):
    df = spark.createDataFrame([("frame_1", "train"), ("frame_2", "test"), ("frame_3", "train")], "frame_id string, split string")
    sinks.write_split_lists(df, str(tmp_path / "splits"))
    lists = spark.read.text(str(tmp_path / "splits"))
    assert sorted((r.split, r.value) for r in lists.collect()) == [("test", "camera/frame_2.png"), ("train", "camera/frame_1.png"), ("train", "camera/frame_3.png")]
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.bin").write_bytes(b"content")
    row = sinks.checksums(spark, str(tmp_path / "a")).first()
    assert (row.length, row.sha256) == (7, hashlib.sha256(b"content").hexdigest())


def test_column_helpers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(R.first_token(F.lit("It is BAD, not good"), ("good", "bad"))) == "good" and one(R.first_token(F.lit("x"), ("good",))) is None
    assert [one(R.fold_class(F.lit(c))) for c in ("cyclist", "pedestrian", "sign")] == ["human", "human", "sign"]
    box = lambda *v: F.struct(*(F.lit(x).alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), v, strict=True)))
    boxes = spark.range(1).select(box(0, 0, 3, 3).alias("a"), box(2, 2, 5, 5).alias("b"), box(9, 9, 9, 9).alias("c"))
    assert tuple(boxes.select(R.box_iou("a", "b"), R.box_iou("a", "c"), R.box_iou("a", "a")).first()) == (4 / 28, 0.0, 1.0)
    at = [tuple(r) for r in spark.range(6).select(raster.nearest_index(F.col("id"), 3, 6), raster.nearest_index(F.col("id"), 3, 6, "centre"), raster.nearest_index(F.col("id"), 4, 6, "centre")).collect()]
    assert at == [(0, 0, 0), (0, 0, 1), (1, 1, 1), (1, 1, 2), (2, 2, 3), (2, 2, 3)]


def test_component_ids_do_not_depend_on_the_right_most_pixel(spark):
    pixels = [(f, y, x, 1) for f, last in ((1, 12), (2, 15)) for y, x in ((2, 11), (5, last))]
    df = spark.createDataFrame(pixels, "frame long, y int, x int, c int")
    assert {(r.frame, r.component) for r in raster.components(df, "c", 16).collect()} == {(1, 43), (2, 43), (1, 92), (2, 95)}


def test_ranks_places_and_samples(spark):
    df = spark.createDataFrame([(i * 37 % 101, i % 4) for i in range(101)], "v long, g int")
    ranked = select.ranked(df, F.floor(F.col("v") / 10), "v").collect()
    assert all(r.rank == r.v + 1 for r in ranked)
    got = select.at_places(df.where("v < 100"), "v", {"median": lambda n: F.floor(n / 2), "last": lambda n: n - 1}).first()
    assert (got.median, got.last) == (50, 99)
    sample = select.sampled(df, 3, 1, "v", "g")
    assert {r["g"]: r["count"] for r in sample.groupBy("g").count().collect()} == dict.fromkeys(range(4), 3)
    assert sorted(sample.collect()) == sorted(select.sampled(df.repartition(7), 3, 1, "v", "g").collect())


def test_quotas_of_small_strata():
    sizes = [("w", "w__common", 100), ("w", "w__rare", 10), ("x", "x__common", 3), ("x", "x__rare", 2), ("y", "y__common", 1)]
    got = {s: (t, v) for s, t, v in splits.stratum_quotas(sizes, 0.1, 0.25, 40)}
    assert got["w__common"] == (40, 10) and got["w__rare"] == (2, 1)
    assert got["x__common"] == (1, 1) and got["x__rare"] == (1, 1) and got["y__common"] == (1, 1)


def test_paired_difference_of_f1(spark):
    import numpy as np

    rows = [(f"f{i // 5}", i % 7 > 1, i % 5 > 1, i % 3 > 0) for i in range(600)]
    df = spark.createDataFrame(rows, "frame_id string, a boolean, b boolean, ok boolean").withColumn("g", F.lit("all"))
    terms = {f"{k}_{r}": e.cast("int") for r in "ab" for k, e in (("tp", F.col(r) & F.col("ok")), ("fp", F.col(r) & ~F.col("ok")), ("fn", ~F.col(r) & F.col("ok")))}
    got = stats.cluster_interval(df, "frame_id", terms, stats.f1_difference, "g", iterations=4000).first()
    table = np.zeros((120, 6))
    for f, a, b, ok in rows:
        table[int(f[1:])] += [a and ok, a and not ok, not a and ok, b and ok, b and not ok, not b and ok]
    draws = stats.f1_difference(table[np.random.default_rng(1).integers(0, 120, (4000, 120))].sum(axis=1))
    low, high = np.percentile(draws, [2.5, 97.5])
    assert got.point == pytest.approx(stats.f1_difference(table.sum(axis=0, keepdims=True))[0])
    assert got.low == pytest.approx(low, abs=0.1 * (high - low)) and got.high == pytest.approx(high, abs=0.1 * (high - low))

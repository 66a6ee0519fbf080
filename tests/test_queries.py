"""Every audit query with SQL against DuckDB on the smallest tables; invariants of the rules."""

import itertools

import pytest
from harness import connect, differences
from pyspark.sql import functions as F

from regionaudit.functions import rules as R
from regionaudit.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def brute(bbox, quality, consistency, protect):
    sure = quality != "good"
    votes = 0
    if bbox == "invalid":
        votes += 2 if consistency == "pass" and sure else 1
    if bbox == "background":
        votes += 2 if sure or not protect else 1
    votes += (quality == "bad") + (consistency == "fail")
    if votes >= 2:
        return "reject"
    return "accept" if (bbox, quality, consistency) == ("valid", "good", "pass") else "human_review"


@pytest.mark.parametrize("protect", [False, True])
def test_truth_table_of_all_36_signals(spark, protect):
    rows = list(itertools.product(["valid", "invalid", "background", None], ["good", "bad", None], ["pass", "fail", None]))
    df = spark.createDataFrame(rows, "b string, q string, c string")
    got = df.select("b", "q", "c", R.decide(F.col("b"), F.col("q"), F.col("c"), protect)).collect()
    assert len(got) == 36
    assert all(r[3] == brute(r.b, r.q, r.c, protect) for r in got)


def test_same_verdict_never_flips(spark):
    assert QUERIES["cascade"](spark, SF).first().flip_same_verdict == 0


def test_degenerate_replies(spark):
    rows = [("??????????",), (None,), ("",), ("  ",), ("sign",), ("é",), ("7",), ("...",)]
    got = [r[0] for r in spark.createDataFrame(rows, "raw string").select(R.degenerate(F.col("raw"))).collect()]
    assert got == [True, True, True, True, False, False, False, True]


def test_incident_counts(spark):
    counts = {"??????????": 43784, "sign": 4907, "vehicle": 4481, "other": 1968, "pedestrian": 272, "cyclist": 218}
    df = spark.createDataFrame(list(counts.items()), "raw string, n long")
    assert df.where(R.degenerate(F.col("raw"))).agg(F.sum("n")).first()[0] == 43784


def test_balanced_split_quotas(spark):
    from regionaudit.operators.splits import balanced

    rows = [(f"frame_{i:03d}", "day", i % 7 * 10, i % 5 * 3) for i in range(100)]
    df = spark.createDataFrame(rows, "frame_id string, cell string, a long, b long")
    got = {r.split: r["count"] for r in balanced(df, "cell", ["a", "b"], {"train": 0.65, "validation": 0.1, "test": 0.25}).groupBy("split").count().collect()}
    assert got == {"train": 65, "validation": 10, "test": 25}


def test_stream_monitor_equals_batch_window(spark, tmp_path):
    from regionaudit.operators.integrity import monitor
    from regionaudit.sources.fixtures import attempts
    from regionaudit.streaming.health import monitored

    df = attempts(spark, SF).select("event_id", F.lit("run").alias("monitor"), "raw")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = monitored(stream, max_rate=0.25).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.event_id: (r.window_bad, r.tripped) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.event_id: (r.window_bad, r.tripped) for r in monitor(df, "event_id", R.degenerate(F.col("raw")), "monitor", max_rate_percent=25).collect()}
    assert got == want


def test_documents_and_export(spark, tmp_path):
    from regionaudit.sources import results

    (tmp_path / "frame_000001.json").write_text('{"frame_id": "frame_000001", "masks": [{"mask_id": 0, "class_name": "sign", "agents": {"bbox": "valid"}}, {"mask_id": 1}], "discovered": []}')
    (tmp_path / "frame_000002.json").write_text('{"frame_id": "frame_0000')
    docs = results.documents(spark, str(tmp_path))
    assert [(r.frame_id, r.mask_id) for r in results.masks(docs).orderBy("ordinal").collect()] == [("frame_000001", 0), ("frame_000001", 1)]
    (tmp_path / "e.csv").write_text("frame,maskId,mask_triage_a,verdict\ncamera/frame_1.png,3,reject,\n")
    row = results.export(spark, str(tmp_path / "e.csv")).first()
    assert (row.frame_id, row.maskId, row.triage_a, row.verdict) == ("frame_1", "3", "reject", None)

"""Painting by frames against its SQL: on the smallest tables, and on frames with repeats, nulls, short and long lists."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from harness import connect, differences

from regionaudit.plans.catalog import ORACLE, QUERIES

NAMES = ("paint_annotation", "class_id_report", "budget_gap")


@pytest.fixture(scope="module")
def odd_frames(tmp_path_factory):
    rng = np.random.default_rng(3)
    draw = lambda n=64: (rng.normal(size=n) * rng.choice([0.1, 0.2, 0.4])).astype("float32").tolist()
    again = draw()
    rows = [(i, draw()) for i in range(300)] + [(400, again)] * 2 + [(401, draw()) for _ in range(3)] + [(i, draw()) for i in (7, 8, 8)]
    rows += [(500, None), (501, []), (502, draw(30)), (503, draw(70)), (504, [None if k % 5 == 0 else v for k, v in enumerate(draw())]), (505, [0.0625] * 64), (506, [0.0205, -0.0195, 0.1505, -0.1505] * 16)]
    rows += [(None, draw()), (None, draw())]
    at = tmp_path_factory.mktemp("odd")
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))}), at / "embeddings.parquet")
    return str(at)


@pytest.mark.parametrize("name", NAMES)
def test_painting_of_odd_frames(spark, odd_frames, name):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # frames go on over batches
    try:
        assert differences(QUERIES[name](spark, odd_frames), connect(odd_frames), ORACLE[name]) == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2048)

"""Resampling intervals against plain versions that draw indices of frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionaudit.functions import rules as R
from regionaudit.operators import stats
from regionaudit.plans.catalog import QUERIES
from regionaudit.sources.fixtures import regions

SF = "/root/testdata/sf0.001"


def close(got, want, width):
    """Percentiles of 10,000 draws scatter by about 0.01 of the interval's width."""
    return got == pytest.approx(want, abs=0.06 * width)


def test_blocks_share_out_every_resample(spark, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK", 16)
    df = spark.createDataFrame([("x" if i % 3 else None, i, 1.0, float(i)) for i in range(300)], "g string, c long, n double, v double")
    rows = stats.resampled(df, "g", "c", ["n", "v"], iterations=2000).collect()
    for g, ids in (("x", [i for i in range(300) if i % 3]), (None, range(0, 300, 3))):
        draws = {r.draw: r for r in rows if r.g == g}
        assert sorted(draws) == list(range(-1, 2000)) and {r.n for r in draws.values()} == {len(ids)}
        v = np.array([draws[i].v for i in range(2000)])
        assert draws[-1].v == sum(ids) and v.std() == pytest.approx(np.std(ids) * len(ids) ** 0.5, rel=0.1)
        assert v.mean() == pytest.approx(sum(ids), abs=5 * v.std() / 2000**0.5)
    assert sorted(rows, key=repr) == sorted(stats.resampled(df.repartition(5), "g", "c", ["n", "v"], iterations=2000).collect(), key=repr)


def test_bootstrap_miou_is_paired_and_stratified(spark):
    tables = {}
    for r in regions(spark, SF).collect():
        frame = tables.setdefault(r.weather, {}).setdefault(r.frame_id, np.zeros((3, len(R.CLASSES))))
        frame[:, R.CLASSES.index(r.class_name)] += r.pixel_count * np.array([r.stored_a != "reject", r.stored_b != "reject", 1])
    rng, point, draws = np.random.default_rng(9), [], []
    for frames in tables.values():
        t = np.stack([frames[f] for f in sorted(frames)])
        miou = lambda s: (s[..., :2, :] / (s[..., 2:, :] + 1e-6)).mean(-1)
        point.append(miou(t.sum(0)))
        draws.append(np.stack([miou(t[rng.integers(0, len(t), len(t))].sum(0)) for _ in range(10_000)]))
    point, draws = np.mean(point, axis=0), np.mean(draws, axis=0)
    got = {r.estimate: r for r in QUERIES["bootstrap_miou"](spark, SF).collect()}
    assert set(got) == {"a", "b", "a-b"} and {r.clusters for r in got.values()} == {sum(map(len, tables.values()))}
    for name, p, d in (("a", point[0], draws[:, 0]), ("b", point[1], draws[:, 1]), ("a-b", point[0] - point[1], draws[:, 0] - draws[:, 1])):
        low, high = np.percentile(d, [2.5, 97.5])
        assert got[name].point == pytest.approx(p) and close(got[name].mean, d.mean(), high - low)
        assert close(got[name].low, low, high - low) and close(got[name].high, high, high - low)
        assert got[name].share_le_0 == pytest.approx((d <= 0).mean(), abs=0.01)


def test_bootstrap_f1_takes_frames(spark):
    sf = "/root/testdata/sf0.01"  # over 1000 frames a class
    tables = {}
    for r in regions(spark, sf).where("human IS NOT NULL").select("class_name", "frame_id", "stored_a", "human").collect():
        keep, ok = r.stored_a != "reject", r.human == "correct"
        tables.setdefault(r.class_name, {}).setdefault(r.frame_id, np.zeros(3))[:] += keep & ok, keep & (not ok), (not keep) & ok
    got = {r.class_name: r for r in QUERIES["bootstrap_f1"](spark, sf).collect()}
    assert set(got) == set(tables)
    for name, frames in tables.items():
        t = np.stack([frames[f] for f in sorted(frames)])
        rng = np.random.default_rng(42)
        draws = np.concatenate([stats.f1(rng.multinomial(len(t), np.full(len(t), 1 / len(t)), size=500) @ t) for _ in range(20)])
        low, high = np.percentile(draws, [2.5, 97.5])
        assert got[name].clusters == len(t) > 1000 and got[name].point == pytest.approx(stats.f1(t.sum(0, keepdims=True))[0])
        assert close(got[name].low, low, high - low) and close(got[name].high, high, high - low)


def test_bounds_need_half_of_the_draws(spark):
    df = spark.createDataFrame([("x", i, 0) for i in range(5)] + [("y", i, 1) for i in range(5)], "g string, c long, t int")
    got = {r.g: (r.clusters, r.low, r.high) for r in stats.cluster_interval(df, "c", {"tp": F.col("t"), "fp": F.lit(0), "fn": F.lit(0)}, stats.f1, "g", iterations=200).collect()}
    assert got == {"x": (5, None, None), "y": (5, 1.0, 1.0)}

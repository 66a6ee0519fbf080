"""The split search over whole weathers: exact quotas, and no swap left that helps."""

import time

import numpy as np

from regionaudit.functions import rules as R
from regionaudit.operators import splits
from regionaudit.plans.catalog import QUERIES
from regionaudit.sources.fixtures import regions

SF = "/root/testdata/sf0.001"
RATIOS = {"train": 65, "validation": 10, "test": 25}


def test_best_swap_in_row_blocks(monkeypatch):
    monkeypatch.setattr(splits, "HELD", 50)
    rng = np.random.default_rng(4)
    for m, n in ((1, 1), (37, 11), (5, 80), (0, 3), (3, 0)):
        left, right, error = rng.random((m, 4)), rng.random((n, 4)), rng.normal(size=4)
        changes = {(i, j): 2 * ((right[j] - left[i]) @ error + ((right[j] - left[i]) ** 2).sum()) for i in range(m) for j in range(n)}
        change, i, j = splits.best_swap(left, right, error)
        if changes:
            assert np.isclose(change, min(changes.values())) and np.isclose(changes[i, j], change)
        else:
            assert change == np.inf


def test_balanced_splits_by_weather(spark):
    of = {r.frame_id: r.split for r in QUERIES["balanced_splits"](spark, SF).collect()}
    frames = {}
    for r in regions(spark, SF).collect():
        frames.setdefault(r.weather, {}).setdefault(r.frame_id, np.zeros(len(R.CLASSES)))[R.CLASSES.index(r.class_name)] += r.pixel_count
    assert set(of) == {f for by in frames.values() for f in by}
    for by in frames.values():
        floors = {s: len(by) * p // 100 for s, p in RATIOS.items()}
        rest = sorted(RATIOS, key=lambda s: -(len(by) * RATIOS[s] % 100))
        quota = {s: n + (s in rest[: len(by) - sum(floors.values())]) for s, n in floors.items()}
        ids = {s: [f for f in by if of[f] == s] for s in RATIOS}
        assert {s: len(x) for s, x in ids.items()} == quota
        px = {f: v / sum(by.values()) for f, v in by.items()}
        error = {s: sum(px[f] for f in ids[s]) - RATIOS[s] / 100 for s in RATIOS}
        assert max(np.abs(e).max() for e in error.values()) < 0.005
        for a, b in (("train", "validation"), ("train", "test"), ("validation", "test")):
            moved = np.array([px[f] for f in ids[b]])[None] - np.array([px[f] for f in ids[a]])[:, None]
            assert (2 * (moved @ (error[a] - error[b]) + (moved**2).sum(-1))).min() > -1e-11


def test_nearest_swap_among_too_many_pairs_to_look_at():
    rng = np.random.default_rng(5)
    left, right = rng.gamma(1, 1, (100_000, 4)), rng.gamma(1, 1, (400_000, 4))
    left[::3, 0], right[1::3, 2] = 0, 0
    start = time.perf_counter()
    for scale in (0.1, 10):
        error = rng.normal(size=4) * scale
        change, i, j = splits.best_swap(left, right, error)
        moved = right[j] - left[i]
        assert np.isclose(change, 2 * (moved @ error + moved @ moved))
        for some, other in ((left[i], right), (left, right[j])):  # no better partner for either, nor among others
            d = other - some
            assert change <= (2 * (d @ error + (d**2).sum(axis=1))).min() * (1 - 1e-9) + 1e-12
        d = right[None, ::400] - left[::100, None]
        assert change <= (2 * (d @ error + (d**2).sum(axis=-1))).min()
    assert time.perf_counter() - start < 30


def test_boxes_after_replacements():
    rng = np.random.default_rng(6)
    rows = rng.random((900, 4))
    a, b = np.arange(300), np.arange(300, 900)
    left, right = splits.Boxes(rows[a], a), splits.Boxes(rows[b], b)
    for _ in range(60):
        error = rng.normal(size=4) * 0.3
        d = rows[b][None] - rows[a][:, None]
        changes = 2 * (d @ error + (d**2).sum(axis=-1))
        change, i, j = splits.nearest_swap(left, right, error)
        x, y = int(np.flatnonzero(a == i)[0]), int(np.flatnonzero(b == j)[0])
        assert np.isclose(change, changes.min()) and np.isclose(change, changes[x, y])
        assert splits.nearest_swap(left, right, error, changes.min() - 1e-9)[1:] == (-1, -1)
        left.replace(i, j, rows[j])
        right.replace(j, i, rows[i])
        a[x], b[y] = j, i

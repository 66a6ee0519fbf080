"""Hypergeometric draws follow their law at every size."""

from collections import Counter
from fractions import Fraction
from math import comb

import numpy as np
import pytest

from regionaudit.llm import sharding


@pytest.mark.parametrize("good,bad,n", [(5, 7, 6), (3, 20, 22), (12, 4, 9), (30, 30, 1), (6, 6, 12), (4, 9, 0), (0, 5, 3), (5, 0, 3)])
def test_inversion_against_exact_shares(good, bad, n):
    rng = np.random.default_rng(3)
    seen = Counter(sharding._inverted(rng, good, bad, n) for _ in range(20_000))
    share = {k: float(Fraction(comb(good, k) * comb(bad, n - k), comb(good + bad, n))) for k in range(max(0, n - bad), min(good, n) + 1)}
    assert set(seen) <= set(share)
    for k, p in share.items():
        assert abs(seen[k] - 20_000 * p) <= 5 * (20_000 * p * (1 - p)) ** 0.5 + 1e-6


def test_law_beyond_a_thousand_million_rows():
    rng, good, total, n = np.random.default_rng(4), 1 << 16, 3 * 10**9, 30_000
    seen = Counter(sharding._hypergeometric(rng, good, total - good, n) for _ in range(20_000))
    p = 1.0
    for i in range(n):
        p *= 1 - good / (total - i)  # none of the n rows falls into the cell
    for k in range(5):
        assert abs(seen[k] - 20_000 * p) <= 5 * (20_000 * p * (1 - p)) ** 0.5
        p *= (good - k) * (n - k) / ((k + 1) * (total - good - n + k + 1))
    draws = [sharding._hypergeometric(rng, good, total - good, total // 2) for _ in range(5000)]
    assert abs(np.mean(draws) - good / 2) < 5 * 128 / 5000**0.5 and np.std(draws) == pytest.approx(128, rel=0.06)


def test_split_keeps_totals_beyond_a_thousand_million_rows():
    cells = np.array([1 << 16] * 40 + [3 * 10**9])
    out = sharding.split(np.random.default_rng(5), cells, 10**9)
    assert out.sum() == 10**9 and (out >= 0).all() and (out <= cells).all()

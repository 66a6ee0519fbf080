"""The candidates of the line join against all pairs, in one process."""

import numpy as np

from regionaudit.llm import _prefix_join as pj
from regionaudit.llm import _sketch
from regionaudit.llm._text import mix

U = np.uint64


def _sets(seed: int, frequent: bool) -> list[np.ndarray]:
    """Sets of 1 to 200 words in clusters of near copies; with ``frequent`` all of a few words."""
    rng, out = np.random.default_rng(seed), []
    words = mix(np.arange(60 if frequent else 4000, dtype=U)) >> U(16)
    for _ in range(60):
        base = rng.choice(words, int(min(len(words), rng.integers(1, 200))), replace=False)
        for _ in range(int(rng.integers(1, 25))):
            own = np.where(rng.random(len(base)) < rng.choice([0.01, 0.1, 0.2]), rng.choice(words, len(base)), base)
            out.append(np.unique(own))
    return list({x.tobytes(): x for x in out}.values())


def _raws(sets: list[np.ndarray], levels: np.ndarray) -> list[bytes]:
    tokens, at = pj.unpacked_tokens(pj.packed_tokens(np.concatenate(sets), np.append(0, np.cumsum([len(s) for s in sets]))))
    key, own, pos, _ = pj._postings(tokens, at, levels, 4, 5)
    bit, half = U(1) << (tokens >> U(34) & U(63)), tokens >> U(33) & U(1)
    bits, more = (np.bitwise_xor.reduceat(bit * x, at[:-1]) for x in (U(1) - half, half))
    column = {"h": key >> U(32), "n": np.diff(at)[own], "pos": pos, "sub": own % 3, "node": own, "first": own // 3, "bits": bits[own], "more": more[own]}
    return [b"".join(column[k].astype(t).view(np.uint8).reshape(len(key), -1).T.tobytes() for k, t in pj._FIELDS)]


def _links(sets: list[np.ndarray]) -> set:
    every = [set(s.tolist()) for s in sets]
    return {(i, j) for j in range(len(every)) for i in range(j) if 5 * len(every[i] & every[j]) >= 4 * len(every[i] | every[j])}


def _levels(sets: list[np.ndarray], factor: int) -> np.ndarray:
    counts = np.bincount((np.concatenate(sets) & U((1 << pj.ORDER_BITS) - 1)).astype(np.int64), minlength=1 << pj.ORDER_BITS)
    return _sketch.levels(counts * factor)


def _got(batches) -> list[tuple]:
    return [tuple(r.values()) for b in batches for r in b.to_pylist()]


def test_every_late_set_has_a_candidate_or_waits():
    for seed, frequent, factor in ((1, False, 1), (2, False, 3000), (3, True, 1), (4, True, 10_000)):
        sets = _sets(seed, frequent)
        links, levels = _links(sets), _levels(sets, factor)
        assert len(links) > 100
        got = _got(pj._block(_raws(sets, levels), 4, 5, None))
        assert all(x < y for x, y, _ in got)
        named, waits = {(x, y) for x, y, _ in got}, {y for _, y, more in got if more}
        for y in {y for _, y in links} - waits:
            assert {(x, y) for x in range(y) if (x, y) in links} <= named
        # the full comparison of what was verified in vain
        asked = np.arange(0, len(sets), 7)
        bitmap = np.zeros(1 << pj.FILTER_BITS, bool)
        bitmap[(mix(asked.astype(U)) & U((1 << pj.FILTER_BITS) - 1)).astype(np.int64)] = True
        full = {(x, y) for x, y, _ in _got(pj._block(_raws(sets, levels), 4, 5, (np.packbits(bitmap, bitorder="little"), None)))}
        assert {(x, y) for x, y in links if y % 7 == 0} <= full


def test_dense_counts_and_bits(spark):
    df = spark.range(1000, numPartitions=3).selectExpr("id % 10 AS h")
    hashes = lambda b: b.column(0).to_numpy().view(U)
    assert _sketch.dense_counts(df, hashes, 10)[:11].tolist() == [100] * 10 + [0]
    bits = _sketch.bucket_bits(df, hashes, 10)
    assert _sketch.in_bitmap(bits, np.arange(12, dtype=U)).tolist() == [True] * 10 + [False] * 2
    assert not _sketch.bucket_bits(df.where("h < 0"), hashes, 10).any()

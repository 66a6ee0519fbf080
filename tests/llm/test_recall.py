"""Decontamination misses no passage: light and heavy edits, and words that many documents share, against whole alignments."""

import numpy as np
import pytest

from regionaudit.llm import decontaminate


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_every_fourth_word_replaced_and_hot_halves(spark):
    stem, rest = [f"s{i}" for i in range(16)], [f"r{i}" for i in range(16)]
    item = stem + rest
    fourth = [f"x{i}" if i % 4 == 3 else x for i, x in enumerate(item)]
    hot = stem + [f"x{i}" if i % 3 == 2 else x for i, x in enumerate(rest)]
    gaps = " ".join(x if i % 3 else f"{x} y{i}" for i, x in enumerate(item)).split()
    rows = [(1, fourth), (2, hot), (3, gaps), *((100 + i, [*stem, f"own{i}"]) for i in range(300))]
    docs = spark.createDataFrame([(d, "before it " + " ".join(w) + " after it") for d, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "a b c d")], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {d: smith_waterman(item, w) / 64 for d, w in rows[:3]} and min(got.values()) >= 0.6
    assert decontaminate.contaminated(docs.where("doc_id >= 100"), bench).count() == 0
    short = spark.createDataFrame([(1, "x a 1 b 2 c 3 d y"), (2, "a 1 b 2 c")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.score, r.first_word, r.last_word) for r in decontaminate.contaminated(short, bench).collect()] == [(1, 8, 5 / 8, 1, 8)]


@pytest.mark.parametrize("held", [1 << 21, 40])
def test_against_whole_alignments(spark, monkeypatch, held):
    monkeypatch.setattr(decontaminate, "HELD", held)
    rng = np.random.default_rng(11)
    items = [rng.integers(0, 40, m).tolist() for m in (4, 5, 6, 7, 9, 12, 16, 20)]
    docs = []
    for d in range(160):
        copy = []
        for x in items[d % len(items)]:
            u = rng.random()
            copy += [] if u < 0.06 else [int(rng.integers(0, 60))] if u < 0.18 else [x, int(rng.integers(0, 60))] if u < 0.26 else [x]
        docs.append([*rng.integers(0, 60, rng.integers(0, 30)).tolist(), *copy, *rng.integers(0, 60, rng.integers(0, 30)).tolist()])
    want = {(d, i): smith_waterman(x, w) / (2 * len(x)) for d, w in enumerate(docs) for i, x in enumerate(items)}
    text = lambda w: " ".join(f"w{x}" for x in w)
    block = next(decontaminate._items(spark.createDataFrame([(i, text(x)) for i, x in enumerate(items)], "i long, t string"), "i", "t", 4, 0.6))
    words = next(decontaminate.chunked(decontaminate.pa.array([text(w) for w in docs], decontaminate.pa.large_string()), fold=True))[1]
    got = {(r, i): s for r, i, s, *_ in decontaminate._matches(words, block)}
    assert got == {k: s for k, s in want.items() if s >= 0.6} and len(got) > 80

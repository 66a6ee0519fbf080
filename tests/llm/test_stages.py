"""Each stage of the pipeline against a plain version, as multisets of rows."""

from collections import Counter

import numpy as np
from harness import connect

import corpus_pipeline
from regionaudit.llm import decontaminate
from regionaudit.llm.oracle import ORACLE

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


def least_of_groups(rows):
    """Of each group of rows that are chained by Jaccard 0.8 of their 5-word shingles, the one with the least id."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in rows for w in [words(r.text)]]
    up = list(range(len(rows)))

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((top(i), top(j)), key=lambda k: rows[k].doc_id)
                up[y] = x
    return [rows[i] for i in range(len(rows)) if top(i) == i]


def test_stages_against_plain_versions(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    assert len({r.doc_id for r in rows}) == len(rows)

    kept = {r[0]: r[1] for r in connect(SF).execute(f"SELECT doc_id, kept FROM ({ORACLE['op7_quality_rules']})").fetchall()}
    df = stages["quality rules"](spark, docs, SF)
    want = [r for r in rows if kept[r.doc_id]]
    assert Counter(df.collect()) == Counter(want) and 0 < len(want) < len(rows)

    df, want = stages["n-gram Jaccard join"](spark, spark.createDataFrame(want, docs.schema), SF), least_of_groups(want)
    assert Counter(df.collect()) == Counter(want)

    number: dict = {}
    code = lambda text: np.array([number.setdefault(w, len(number)) for w in words(text)], np.int64)
    items = [w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [code(r.text)] if len(w) >= 4]
    clean = [r for r in want for w in [code(r.text)] if not any(decontaminate.align(x, w)[0] >= 0.6 * 2 * len(x) for x in items)]
    df = stages["benchmark decontamination"](spark, spark.createDataFrame(want, docs.schema), SF)
    assert Counter(df.collect()) == Counter(clean) and 0 < len(clean)

    mixed = Counter(stages["mixing sources"](spark, spark.createDataFrame(clean, docs.schema), SF).collect())
    size = Counter()
    for r in clean:
        size[r.source] += len(words(r.text))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    target, free = {}, dict(size)
    while free:
        level = (1.5 * sum(size.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * size[s]] or list(free)
        for s in over:
            target[s] = min(2 * size[s], level * weight[s])
            del free[s]
    assert set(mixed) <= set(clean)
    taken = Counter()
    for r in clean:
        whole = int(target[r.source] / size[r.source] + 1e-12)
        assert whole <= mixed[r] <= min(2, whole + 1)
        taken[r.source] += mixed[r] * len(words(r.text))
    for s in size:
        assert abs(taken[s] - target[s]) <= max(len(words(r.text)) for r in clean if r.source == s) / 2 + 1e-6

    rows = list(mixed.elements())
    dealt = stages["sharding"](spark, spark.createDataFrame(rows, docs.schema), SF).collect()
    assert Counter(tuple(r)[:-2] for r in dealt) == Counter(map(tuple, rows))
    shards = {s: sorted(r.slot for r in dealt if r["shard"] == s) for s in range(16)}
    assert all(x == list(range(len(x))) for x in shards.values()) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1

    assert Counter(tuple(r)[:-2] for r in corpus_pipeline.run(spark, SF).collect()) == Counter(map(tuple, rows))

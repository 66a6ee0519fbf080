"""Corpus operators on small tables with nulls, empty and long texts, ties, repeats, clashing columns; and on the smallest files."""

import hashlib
import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from harness import connect, differences

from regionaudit.llm import decontaminate, language_id, line_dedup, mixing, ngram_join, quality_rules, sharding, substring_dedup, token_store, url_filter
from regionaudit.llm.oracle import ORACLE
from regionaudit.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, bucket int"
LONG = " ".join(f"w{i % 977} the" for i in range(4000))
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from it all", "en", "a"), (2, "the quick brown fox jumps over the lazy dog and runs away from it all", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from it all", "en", "a"), (3, None, None, None), (4, "", "en", None), (5, " \n\t ", "en", "b"),
    (None, "a b", "en", "b"), (6, "A B", "de", "b"), (7, LONG, "en", "a"), (8, LONG + " tail", "en", "c"), (9, "é ß\nline one two\nLINE one two\n", "fr", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, "x", 1, 2) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, fold=False):
    raw = (text or "").encode()
    return (raw.lower() if fold else raw).split()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) == []


def test_ngram_components(spark, odd, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(odd).collect()]
    assert len(got) == len(ODD)
    by = {(d, n): c for d, n, c in got}
    assert by[1, 11] == by[2, 11] == 1
    assert by[6, 1] == by[None, 1] == 6
    assert by[7, 7811 if (7, 7811) in by else next(n for d, n, _ in got if d == 7)] == 7
    assert next(c for d, _, c in got if d == 8) == 7
    assert {(d, c) for d, n, c in got if n == 0} == {(3, 3), (4, 4), (5, 5)}
    assert ngram_join.ngram_components(empty).count() == 0
    kept = ngram_join.representatives(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 6, 7, 9])


def test_hot_groups_of_near_copies(spark):
    rng = np.random.default_rng(0)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        for k in rng.integers(0, 120, 2):
            w[k] = f"x{rng.integers(1 << 30)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"r{rng.integers(1 << 30)}" for _ in range(80))) for i in range(50)]
    sets = {d: {tuple(words(t)[i : i + 5]) for i in range(len(words(t)) - 4)} for d, t in rows}
    up = {d: d for d in sets}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if top(a) != top(b) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: top(d) for d in sets}


def test_urls(spark):
    rows = [(1, "http://A.Example.com/en/77?x"), (2, "https://com/en/"), (3, None), (4, "no url"), (5, "ftp://x.example.net/de/8#a"), (6, "http://example.net/de/9"), (7, "http://badcom/en/"), (None, "http://a.org/es/"), (8, "http://a.com?/en/")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(df, url_filter.rule_table(spark)).collect()}
    assert got[1] == ("a.example.com", "/en/77", "example.com/en/7", "allow")
    assert got[2] == ("com", "/en/", "com/en/", "block")
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5][2:] == ("example.net/de/8", "block") and got[6][2:] == ("net/de/", "allow")
    assert got[7][2:] == (None, "allow") and got[None][2:] == ("org/es/", "block") and got[8] == ("a.com", "", None, "allow")


def test_sharding(spark, odd, empty):
    rows = sharding.shard_report(odd, shards=4).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == len(ODD) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert sharding.shard_report(empty).count() == 0
    clash = odd.selectExpr("*", "1 AS shard", "2 AS slot", "3 AS cell", "4 AS __tag", "5 AS Slot_")
    out = sharding.shuffled_documents(clash, 4)
    assert out.columns == [*clash.columns, "shard_", "slot__"] and Counter(tuple(r)[:-2] for r in out.collect()) == Counter(map(tuple, clash.collect()))
    assert sharding.shuffled_documents(empty).count() == 0
    cells, before = np.array([30, 20, 50]), np.array([0, 10, 10, 60, 100])
    matrix = np.stack([sharding.matrix_row(cells, before, p, 3) for p in range(4)])
    assert (matrix.sum(axis=0) == cells).all() and (matrix.sum(axis=1) == np.diff(before)).all()


def test_decontamination(spark, odd, empty):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    edited = item.replace("seven", "SEVENTY").replace("eleven ", "")
    rows = [(1, f"lead in {item} tail"), (2, f"lead {edited} tail tail"), (3, "one two three only"), (4, None), (5, ""), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.score, r.first_word, r.last_word) for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {1, 2, None} and got[1] == (7, 1.0, 2, 17) and 0.6 <= got[2][1] < 1
    assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()) == [3, 4, 5]
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean_documents(odd, bench).count() == len(ODD)
    short = spark.createDataFrame([(1, "it is Too Short."), (2, "too, short"), (3, "this is too short indeed"), (4, "too very short")], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(short, bench).collect()] == [3]
    named = spark.createDataFrame([("a", item), ("a", item), ("b", "x " + item), ("c", None)], "doc_id string, text string")
    assert [r.doc_id for r in decontaminate.clean_documents(named, bench).collect()] == ["c"]
    assert sorted((r.doc_id or "") for r in ngram_join.representatives(named.union(spark.createDataFrame([(None, item)], named.schema))).collect()) == ["a", "c"]
    assert ngram_join.representatives(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0 and quality_rules.kept_documents(empty).count() == 0


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_against_the_plain_recurrence():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        assert decontaminate.align(a, b)[0] == smith_waterman(a.tolist(), b.tolist())


def test_line_dedup(spark, odd, empty):
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()))
    lines = [(d, i, set(words(x, True))) for d, t in rows for i, x in enumerate(t.split("\n"))]
    gone, by = set(), {}
    for k, (d, i, w) in enumerate(lines):
        for j in set().union(*(by.get(t, ()) for t in w)):
            if 5 * len(w & lines[j][2]) >= 4 * len(w | lines[j][2]):
                gone.add((d, i))
                break
        for t in w:
            by.setdefault(t, []).append(k)
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}
    small = Counter((r.doc_id, r.n_lines, r.n_removed) for r in line_dedup.deduplicated(odd).collect())
    assert small[1, 1, 0] == 1 and small[2, 1, 1] == 2 and small[3, 0, 0] == 1 and small[4, 1, 0] == 1 and small[9, 4, 1] == 1
    assert line_dedup.deduplicated(empty).count() == 0


def test_token_store(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = sorted(token_store.token_report(odd, tokenizer_path(), str(tmp_path / "s")).collect(), key=lambda r: r.start)
    start, seen = 0, []
    for r in got:
        assert r.start == start
        start += r.n_tokens
        seen.append((r.doc_id, r.n_tokens, r.ids_crc32))
    want = [(d, len(ids := [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, t, *_ in ODD]
    assert Counter(seen) == Counter(want)
    assert [d for d, *_ in seen] == sorted((d for d, *_ in seen), key=lambda d: (d is not None, d or 0))
    assert token_store.token_report(empty, tokenizer_path(), str(tmp_path / "e")).count() == 0


def test_tokenize_as_the_library_does(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(tokenizer_path()), np.random.default_rng(3)
    bits = ["the", "Ab", "it's", " ", "  ", "\n", "\n\n", "\t", "\r\n", "1234", "é", "ß", "漢字", "\u00a0", "\u2003", "🙂", "<|endoftext|>", "<|", "...", "''", "x" * 70]
    texts = ["", " ", "\n", "<|endoftext|>", "see <|endoftext|> here", *("".join(rng.choice(bits, int(rng.integers(1, 30)))) for _ in range(4000))]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[4] == [3826, 220, 50256, 994]
    monkeypatch.setattr(token_store._Pieces, "MOST", 300)
    monkeypatch.setattr(token_store, "_known", {})
    for size in (1, 7, 512, len(texts)):
        got = []
        for low in range(0, len(texts) if size > 1 else 300, size):
            ids, at = token_store.tokenize(tokenizer_path(), pa.array(texts[low : low + size], pa.string()))
            got += [x.tolist() for x in np.split(ids, at[1:-1])]
        assert got == want[: len(got)]


def test_texts_are_tokenized_in_runs_of_bounded_bytes(spark, tmp_path):
    texts = pa.array(["a" * n for n in (3, 0, 4, 9, 1, 1, 1, 20)] + [None, "bb"])
    assert list(token_store.runs(texts, 8)) == [(0, 3), (3, 4), (4, 7), (7, 8), (8, 10)]
    assert list(token_store.runs(texts)) == [(0, 10)] and not list(token_store.runs(texts[:0]))
    docs = spark.range(1200).selectExpr("id AS doc_id", "repeat(concat(' w', id), 900) AS text")
    token_store.write_store(docs.coalesce(1), str(tmp_path / "s"), tokenizer_path())
    rows = spark.read.parquet(str(tmp_path / "s")).selectExpr("n_ids", "size(doc_ids) AS docs", "array_max(lengths) AS longest").collect()
    assert sum(r.docs for r in rows) == 1200 and max(r.n_ids - r.longest for r in rows) < 1 << 20  # rows of some 2 MB, whatever the task has


def test_rans_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for ids in (np.array([2]), rng.integers(0, 50257, 70000), np.minimum(rng.geometric(0.2, 100000), 40), np.full(1000, 7)):
        segment = token_store.encode(ids.astype(np.uint32))
        assert (token_store.decode(segment) == ids).all()
    blocks = len(segment["crcs"]) // 4
    segment = token_store.encode(np.minimum(rng.geometric(0.2, 100000), 40).astype(np.uint32))
    assert (token_store.decode(segment, 1, 2) == token_store.decode(segment)[token_store.BLOCK : 2 * token_store.BLOCK]).all() and blocks == 1
    broken = bytearray(segment["words"])
    broken[100] ^= 1
    with pytest.raises((ValueError, IndexError)):
        token_store.decode(segment | {"words": bytes(broken)})


def test_quality(spark, odd, empty):
    got = [r for r in quality_rules.quality_verdicts(odd).collect()]
    assert len(got) == len(ODD) and not any(r.kept for r in got if r.doc_id in (3, 4, 5))
    assert next(r.n_dup_lines for r in got if r.doc_id == 9) == 0
    assert quality_rules.quality_verdicts(empty).count() == 0
    assert quality_rules.kept_documents(odd).columns == odd.columns


def test_substring_dedup(spark, odd, empty):
    rng = np.random.default_rng(2)
    shared = [f"s{i}" for i in range(60)]
    texts = [" ".join([*(f"{d}_{i}" for i in range(rng.integers(0, 50))), *shared[rng.integers(0, 20) : rng.integers(40, 60)], *(f"{d}-{i}" for i in range(30))]) for d in range(40)]
    texts += ["p q r " * 30, "z " * 36, "z " * 35, texts[3], texts[3]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(44, texts[3]), (None, None)]
    count = Counter(tuple(w[i : i + 35]) for _, t in rows for w in [words(t)] for i in range(len(w) - 34))

    def cut(t):
        w = words(t)
        gone = {i + k for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for k in range(35)}
        return len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()

    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((d, *cut(t)) for d, t in rows)
    assert substring_dedup.deduplicated(odd).count() == len(ODD) and substring_dedup.deduplicated(empty).count() == 0


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    small = language_id.languages(odd).collect()
    assert {r.lang_pred for r in small if r.doc_id in (3, 4, 5)} == {"und"} and len(small) == len(ODD)
    signs = docs.limit(0).union(docs.sparkSession.createDataFrame([(1, "½ ² 12 _ Ⅷ!", None, None, None), (2, "12 ª", None, None, None)], docs.schema))
    told = {r.doc_id: (r.lang_pred, r.score) for r in language_id.languages(docs.union(signs)).where("doc_id IN (1, 2) AND score = 0 OR doc_id = 2").collect()}
    assert told.get(1) == ("und", 0.0) and told[2][0] != "und"
    assert language_id.languages(empty).count() == 0


def water_fill(sizes, weights, budget, epochs):
    target, free = {}, dict(sizes)
    while free:
        level = (budget - sum(target.values())) / sum(weights[s] for s in free)
        over = [s for s in free if level * weights[s] > epochs * sizes[s]]
        if not over:
            return target | {s: level * weights[s] for s in free}
        for s in over:
            target[s] = epochs * sizes[s]
            del free[s]
    return target


def test_mixing(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix_report(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r["size"]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    want = water_fill(sizes, weights, 1.5 * sum(sizes.values()), 2)
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(want[r.source]) and r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= 0.06 * want[s] for s in sizes)
    again = {(r.doc_id, r.taken) for r in mixing.mix_report(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    assert mixing.mix_report(odd).count() == len(ODD) and mixing.mix_report(empty).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "shard", "slot"]
    ids, kept = {r.doc_id for r in out.collect()}, {r.doc_id for r in quality_rules.quality_verdicts(docs).collect() if r.kept}
    leaks = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids and ids <= kept - leaks and json.dumps(sorted(ids))

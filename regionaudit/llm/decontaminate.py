"""Benchmark decontamination: shared word pairs find passages of test items, Smith-Waterman scores them.

An alignment with the least score has so few errors that a number of the item's word pairs stand unbroken in a
stretch of bounded length (for the shortest items: so many of its words).  Where a document has that many of them that
close together it is aligned with the item, so that no passage is missed, however frequent its words are; it is
reported if the score reaches a share of the item's score against itself.  Items go to the executors in blocks of
bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._text import Words, chunked

#: Items of fewer words are searched for as they are, without edits; and items of a block.
LEAST_WORDS, BLOCK_ITEMS = 4, 4096
MATCH, MISMATCH, GAP = 2, 1, 1
#: Pairs of a place and an item that a task holds at a time, but for those of a single row.
HELD = 1 << 21
#: Share of the item's score against itself from which on a passage counts as a copy.
LEAST_SCORE = 0.6


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment of two word sequences: score, and where in the passage it ends (exclusive)."""
    best, end = 0, 0
    row = np.zeros(len(passage) + 1, np.int64)
    slope = GAP * np.arange(len(passage) + 1)
    for w in item:
        step = np.maximum(row[:-1] + np.where(passage == w, MATCH, -MISMATCH), row[1:] - GAP)
        new = np.concatenate([[0], np.maximum(step, 0)])
        row = np.maximum.accumulate(new + slope) - slope
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def _asked(m: int, least: float) -> tuple[int, int, int]:
    """Words of a seed, how many seeds a passage of an item of m words has at least, and words of a passage at most.

    With M matches and E errors, MATCH * M - E * (least penalty) reaches the score: E is at most ``errors``, the matches
    are in E + 1 runs, and M - E - 1 pairs are unbroken, fewest where M = m.
    """
    errors = int(MATCH * m * (1 - least) / min(MISMATCH, GAP) + 1e-9)
    pairs = m - errors - 1
    return (2, pairs, m + errors) if pairs > 0 else (1, max(1, int(np.ceil(least * m - 1e-9))), m + errors)


def _items(benchmark: DataFrame, id_column: str, text_column: str, least_words: int, least: float) -> Iterator[dict]:
    """Blocks of items: ids, word hashes, what a passage has at least, and the seeds as sorted hashes with their item."""
    held: list = []
    for row in benchmark.select(F.col(id_column).alias("i"), F.coalesce(F.col(text_column), F.lit("")).alias("t")).toLocalIterator():
        held.append(row)
        if len(held) == BLOCK_ITEMS:
            yield _item_block(held, least_words, least)
            held = []
    if held:
        yield _item_block(held, least_words, least)


def _item_block(rows: list, least_words: int, least: float) -> dict:
    texts = pa.array([r.t for r in rows], pa.large_string())
    sequences: list[np.ndarray] = []
    score: list[float] = []  # share of its own score that a passage of the item has at least
    found: dict[int, tuple[list, list]] = {1: ([], []), 2: ([], [])}
    for low, w in chunked(texts, fold=True):
        runs = {n: w.runs(n) for n in found}
        for r in range(len(w.rows) - 1):
            own = w.hashes[w.rows[r] : w.rows[r + 1]]
            sequences.append(own)
            score.append(least if len(own) >= least_words else 1.0)
            if len(own):
                n = _asked(len(own), score[-1])[0]
                grams, at = runs[n]
                mine = np.unique(grams[at[r] : at[r + 1]])
                found[n][0].append(mine)
                found[n][1].append(np.full(len(mine), low + r))
    seeds = {}
    for n, (gram, item) in found.items():
        if gram:
            gram, item = np.concatenate(gram), np.concatenate(item)
            order = np.lexsort((item, gram))
            seeds[n] = (gram[order], item[order])
    asked = np.array([_asked(len(x), s)[1:] for x, s in zip(sequences, score, strict=True)], np.int64).reshape(-1, 2)
    return {"ids": [r.i for r in rows], "words": sequences, "least": score, "need": asked[:, 0], "span": asked[:, 1], "seeds": seeds}


def _stretches(w: Words, block: dict) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, first word, last word) of stretches that hold every passage with the least score."""
    for n, (gram, of) in block["seeds"].items():
        grams, at = w.runs(n)
        if not len(grams):
            continue
        low = np.searchsorted(gram, grams, "left")
        found = np.flatnonzero(gram[np.minimum(low, len(gram) - 1)] == grams)
        low = low[found]
        many = np.searchsorted(gram, grams[found], "right") - low
        rows = np.searchsorted(at, found, "right") - 1
        upto = np.cumsum(many)
        ends = np.flatnonzero(np.diff(rows, append=-1)) + 1  # of rows
        a = 0
        while a < len(found):
            held = upto[ends - 1] - (upto[a] - many[a]) <= HELD
            b = int(max(ends[held].max(initial=0), ends[np.searchsorted(ends, a, "right")]))
            size = many[a:b]
            item = of[np.repeat(low[a:b], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            row, place = np.repeat(rows[a:b], size), np.repeat(found[a:b] - at[rows[a:b]], size)
            order = np.lexsort((place, item, row))
            row, item, place = row[order], item[order], place[order]
            need, span = block["need"][item], block["span"][item]
            last = np.minimum(np.arange(len(row)) + need - 1, len(row) - 1)
            first = np.flatnonzero((np.arange(len(row)) + need <= len(row)) & (row[last] == row) & (item[last] == item) & (place[last] - place < span))
            live = np.zeros(len(row) + 1, np.int64)
            np.add.at(live, first, 1)
            np.add.at(live, last[first] + 1, -1)
            keep = np.flatnonzero(np.cumsum(live[:-1]) > 0)
            row, item, place, span = row[keep], item[keep], place[keep], span[keep]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] >= span[1:])
            cuts = np.flatnonzero(new)
            for x, y in zip(cuts, [*cuts[1:], len(row)][: len(cuts)], strict=True):
                yield int(row[x]), int(item[x]), max(0, int(place[x] - span[x])), int(place[y - 1] + span[x]) + n
            a = b


def _matches(w: Words, block: dict) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, last word) for rows with a passage of an item."""
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for r, i, first, last in _stretches(w, block):
        own, m, least = w.hashes[w.rows[r] : w.rows[r + 1]], len(block["words"][i]), block["least"][i]
        if np.isin(block["words"][i], own[first:last]).sum() < least * m - 1e-9:  # each match is one of these words
            continue
        score, end = align(block["words"][i], own[first:last])
        share = score / (MATCH * m)
        if share >= least and share > best.get((r, i), (0.0,))[0]:
            back, begin = align(block["words"][i][::-1], own[first : first + end][::-1])
            best[r, i] = (share, first + end - begin, first + end)
    for (r, i), found_ in best.items():
        yield r, i, *found_


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", least_words: int = LEAST_WORDS, least: float = LEAST_SCORE) -> DataFrame:
    """Documents with a passage of a test item: id_column, item_column, score, first_word, last_word (exclusive).

    One row for each document row and item of which it has a passage with ``least`` of the item's alignment
    score against itself, at its best passage.  Words are compared with A-Z lower-cased.  Null, empty and blank
    texts have none; items under ``least_words`` words count only where they stand as they are; empty items, an empty
    benchmark and an empty table give nothing; null ids stay null; repeated rows
    are reported as often as they come; extra columns are ignored.
    """
    id_type, item_type = docs.schema[id_column].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString()
    spark, out = docs.sparkSession, None
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    for block in _items(benchmark, item_column, item_text, least_words, least):
        if not block["seeds"]:
            continue
        seeds = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, found = [], []
                for low, w in chunked(batch.column(1), fold=True):
                    for r, *rest in _matches(w, seeds.value):
                        rows.append(low + r)
                        found.append(rest)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([seeds.value["ids"][f[0]] for f in found], kind), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64())], ["id", "item", "score", "first_word", "last_word"])

        kind = to_arrow_type(benchmark.schema[item_column].dataType)
        part = slim.mapInArrow(search, f"id {id_type}, item {item_type}, score double, first_word long, last_word long")
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], f"id {id_type}, item {item_type}, score double, first_word long, last_word long")
    return out.withColumnsRenamed({"id": id_column, "item": item_column})


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that have a passage of a test item (see contaminated): repeats go together, rows without a text stay."""
    key = F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "doc_id", "text").alias("b"))
    bad = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("key")).distinct()
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    return packed.join(bad, "key", "left_anti").select("row.*")

"""Substring deduplication: words in windows that occur anywhere else go.

Every window of WINDOW words has an anchor, its word n-gram of least hash (the first of several), and equal
windows have equal anchors.  Consecutive windows of a document with one anchor are a segment; each window is in
just one.  Segments meet by anchor.  Those with equal contents are repeated as a whole.  The others' words go
to shards by anchor, a shard's FM-index (_fm_index) gives matching statistics of its segments by backward
search, and intervals of windows that occur twice are reported.  A document's words that no reported window
covers are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._fm_index import repeated_windows
from ._scratch import written
from ._text import _BASE, _UNBASE, U, Words, chunked, mix

WINDOW, GRAM = 35, 8
#: Words of the segments that one FM-index holds; segments with equal anchors stay together.
SHARD_WORDS = 1 << 18

_SEGMENT = np.dtype([("g", "<u8"), ("seg", "<u8"), ("row", "<i8"), ("lo", "<u4"), ("n", "<u2"), ("flag", "<u2")])
_ALONE, _SEVERAL, _REPEAT = 0, 1, 2
RESOLVED, OPEN, REFERENCE = 0, 1, 2


def _segments(w: Words, window: int, gram: int) -> np.ndarray:
    """Segments of some rows: anchor, hash of contents, row (its number), first window, number of windows."""
    grams, at = w.runs(gram)
    span = window - gram + 1
    if len(grams) < span:
        return np.empty(0, _SEGMENT)
    n = np.maximum(np.diff(w.rows) - window + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    first = at[row] + start
    anchor = first + view[first].argmin(axis=1) if len(first) < len(view) // 2 else first + view.argmin(axis=1)[first]
    new = np.ones(len(row), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    begin = np.flatnonzero(new)
    out = np.empty(len(begin), _SEGMENT)
    out["g"], out["row"], out["lo"] = grams[anchor[begin]], row[begin], start[begin]
    out["n"] = np.diff(np.append(begin, len(row)))
    power = np.cumprod(np.full(len(w.hashes) + 1, _BASE))
    total = np.concatenate([np.zeros(1, U), np.cumsum(w.hashes * power[:-1])])
    a = w.rows[row[begin]] + start[begin]
    b = a + out["n"] + window - 1
    back = np.cumprod(np.full(len(w.hashes) + 1, _UNBASE))
    out["seg"] = mix((total[b] - total[a]) * back[a] + (b - a).astype(U))
    out["flag"] = _ALONE
    return out


def _hits(df: DataFrame, window: int, gram: int) -> DataFrame:
    """Segments whose anchor occurs elsewhere: row, kind, g, lo, n."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = 4 * parts

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            s = np.concatenate(held)
            s = s[np.lexsort((s["seg"], s["g"]))]
            same = np.zeros(len(s), bool)
            same[1:] = (s["g"][1:] == s["g"][:-1]) & (s["seg"][1:] == s["seg"][:-1])
            # of equal segments one goes on for the others, which are settled and spread by row
            s["flag"][same] = _REPEAT
            s["flag"][np.flatnonzero(same[1:] & ~same[:-1])] = _SEVERAL
            block = (np.where(same, mix(s["row"].astype(U)), s["g"]) % U(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            s, block = s[order], block[order]
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            raw = [s[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(block)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(block[cuts], pa.int32()), pa.array(raw, pa.binary())], ["block", "packed"])

        n = 0
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            for low, w in chunked(batch.column(1)):
                s = _segments(w, window, gram)
                s["row"] = rows[low + s["row"]]
                held.append(s)
                n += len(s)
            if n > 1 << 20:
                yield packed()
                held, n = [], 0
        if n:
            yield packed()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(block, []).append(raw)
        while by:
            s = np.frombuffer(b"".join(by.popitem()[1]), _SEGMENT)
            settled, s = s[s["flag"] == _REPEAT], s[s["flag"] != _REPEAT]
            s = s[np.lexsort((s["seg"], s["g"]))]
            g = np.unique(s["g"], return_inverse=True)[1]
            pair = np.cumsum(np.concatenate([[0], (s["g"][1:] != s["g"][:-1]) | (s["seg"][1:] != s["seg"][:-1])])) if len(s) else np.empty(0, np.int64)
            several = (np.bincount(pair)[pair] > 1) | (np.bincount(pair, s["flag"])[pair] > 0) if len(s) else np.empty(0, bool)
            leads = np.concatenate([[True], pair[1:] != pair[:-1]]) if len(s) else several
            kinds = np.bincount(g[leads]) if len(s) else np.empty(0, np.int64)  # different contents of an anchor
            mixed = kinds[g] > 1 if len(s) else several
            for part, kind in ((settled, RESOLVED), (s[several], RESOLVED), (s[~several & mixed], OPEN), (s[several & leads & mixed], REFERENCE)):
                if len(part):
                    col = lambda k: pa.array(part[k].astype(np.int64))  # noqa: B023,E731
                    yield pa.RecordBatch.from_arrays([col("row"), pa.array(np.full(len(part), kind, np.int32)), pa.array(np.ascontiguousarray(part["g"]).view(np.int64)), col("lo"), col("n")], ["row", "kind", "g", "lo", "n"])

    packed = df.mapInArrow(post, "block int, packed binary").repartition(parts, "block")
    return packed.mapInArrow(join, "row long, kind int, g long, lo long, n long")


def repeated_intervals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """For docs (row, text): row, lo, n: windows lo to lo + n - 1 of the row's words occur elsewhere."""
    hits = written(_hits(docs, window, gram))
    open_ = hits.where(F.col("kind") != RESOLVED)
    lists = open_.groupBy("row").agg(F.collect_set(F.struct("kind", "g", "lo", "n")).alias("hits"))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(2).to_pylist()
            rows = batch.column(0).to_pylist()
            for low, w in chunked(batch.column(1)):
                out = []
                for r in range(len(w.rows) - 1):
                    own = w.hashes[w.rows[r] : w.rows[r + 1]]
                    out += [(rows[low + r], x["kind"], x["g"], x["lo"], own[x["lo"] : x["lo"] + x["n"] + window - 1].tobytes()) for x in hits[low + r]]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["row", "kind", "g", "lo", "words"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:  # sorted by anchor
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SHARD_WORDS and x[2] != held[-1][2]:
                    yield _searched(held, window)
                    held, size = [], 0
                held.append(x)
                size += len(x[4]) // 8
        if held:
            yield _searched(held, window)

    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    segments = docs.join(lists, "row").select("row", "text", "hits")
    segments = segments.mapInArrow(contents, "row long, kind int, g long, lo long, words binary")
    found = segments.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(search, "row long, lo long, n long")
    return hits.where(F.col("kind") == RESOLVED).select("row", "lo", "n").union(found)


def _searched(held: list[tuple], window: int) -> pa.RecordBatch:
    every = np.frombuffer(b"".join(x[4] for x in held), np.uint64)
    length = np.array([len(x[4]) // 8 for x in held])
    codes = np.unique(every, return_inverse=True)[1] + 1
    ends = np.cumsum(length + 1) - 1  # each segment is followed by a separator
    starts = ends - length
    text = np.zeros(int(ends[-1]) + 2, np.int64)  # and the text by one of its own
    place = np.arange(len(every)) + np.repeat(np.arange(len(held)), length)
    text[place] = codes
    twice = repeated_windows(text, starts, ends, window)
    edge = np.diff(twice.astype(np.int8), prepend=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.searchsorted(starts, first, "right") - 1
    keep = np.array([held[i][1] == OPEN for i in of.tolist()], bool)
    first, last, of = first[keep], last[keep], of[keep]
    return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in of.tolist()], pa.int64()), pa.array([held[i][3] for i in of.tolist()] + first - starts[of] if len(of) else [], pa.int64()), pa.array(last - first, pa.int64())], ["row", "lo", "n"])


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each document: id_column, n_words, n_removed, text (kept words joined by one blank) and kept_sha256.

    A word goes if a window of ``window`` consecutive words over it also starts anywhere else, in the same
    document or another; words are compared as they are, and all windows are those of the input.  A null, empty
    or blank text has no words and an empty text.  Repeated rows are occurrences of their own.  Other columns are
    ignored.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    df = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).withColumn("row", F.xxhash64("id", "text"))
    found = written(repeated_intervals(df.select("row", "text"), window, gram))
    lists = found.groupBy("row").agg(F.collect_set(F.struct("lo", "n")).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, texts, digests = [], [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                w = text.encode().split()
                n.append(len(w))
                if gone:
                    change = np.zeros(len(w) + 1, np.int64)
                    for x in gone:
                        change[x["lo"]] += 1
                        change[x["lo"] + x["n"] + window - 1] -= 1
                    keep = np.cumsum(change[:-1]) == 0
                    w = [x for x, k in zip(w, keep.tolist(), strict=True) if k]
                removed.append(n[-1] - len(w))
                raw = b" ".join(w)
                texts.append(raw.decode())
                digests.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), pa.array(digests, pa.string())], ["id", "n_words", "n_removed", "text", "kept_sha256"])

    joined = df.join(lists, "row", "left").select("id", "text", "gone")
    return joined.mapInArrow(cut, f"id {id_type}, n_words long, n_removed long, text string, kept_sha256 string").withColumnRenamed("id", id_column)

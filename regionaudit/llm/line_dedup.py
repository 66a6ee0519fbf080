"""Line deduplication by exact set-similarity join.

A line is the set of its words (A-Z lower-cased).  Words are ordered by rarity, lines become candidates by prefix,
position and length filters (_prefix_join), Jaccard similarity is counted exactly, and a line goes if a similar line
stands earlier.  Texts are split into words once; what follows works on a table of lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _prefix_join as pj
from ._scratch import drop, written
from ._text import U, columns, mix, words

NUM, DEN = 4, 5
#: Sets that a task remembers at a time, to post repeats once.
ROOM = 1 << 20
_LINES = "first long, row long, sub int, node long, other long, again boolean, tokens binary"


@dataclass
class Lines:
    """Lines with words: text row and number of each, their sets (tokens[at[i]:at[i + 1]]) and the sets' keys (n, 2)."""

    rows: np.ndarray
    numbers: np.ndarray
    tokens: np.ndarray
    at: np.ndarray
    keys: np.ndarray


def lines(text: pa.Array) -> Iterator[Lines]:
    """The lines of a column that have words, some rows at a time."""
    data, bounds = columns(text)
    low = 0
    while low < len(bounds) - 1:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + (1 << 19), "right")) - 1)
        part, own = data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
        edges = np.unique(np.concatenate([own, np.flatnonzero(part == 10) + 1]))
        edges = edges if len(edges) > 1 else np.array([0, 0])
        w = words(part, edges, fold=True)
        rows = np.searchsorted(own, edges[:-1], "right") - 1
        numbers = np.arange(len(rows)) - np.searchsorted(rows, rows)  # blank lines are numbered too
        full = np.flatnonzero(np.diff(w.rows))
        for k in range(0, len(full), 1 << 16):
            some = full[k : k + (1 << 16)]
            of = np.repeat(np.arange(len(some)), np.diff(w.rows)[some])
            packed = np.sort(of.astype(U) << U(48) | w.hashes[w.rows[some[0]] : w.rows[some[-1] + 1]] >> U(16))
            packed = packed[np.append(True, packed[1:] != packed[:-1])]
            tokens = packed & U((1 << 48) - 1)
            at = np.append(0, np.cumsum(np.bincount((packed >> U(48)).astype(np.int64))))
            keys = np.empty((len(some), 2), U)
            for j in range(2):
                total = np.append(U(0), np.cumsum(mix(tokens + U(0x5851F42D4C957F2D * (j + 1) % 2**64))))
                keys[:, j] = mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(U))
            yield Lines(rows[some] + low, numbers[some], tokens, at, keys)
        low = high


def _line_table(docs: DataFrame) -> DataFrame:
    """A row for each line of docs (first, row, text) that has words: its place (first, sub), whether its task has met an
    equal set at an earlier place (again), and the tokens of sets at a new place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple] = {}
        for batch in batches:
            first, row = batch.column(0).to_numpy(), batch.column(1)
            for own in lines(batch.column(2)):
                place = first[own.rows]
                again, post = np.zeros(len(place), bool), np.zeros(len(place), bool)
                for i, (k, a, b) in enumerate(zip(map(tuple, own.keys.tolist()), place.tolist(), own.numbers.tolist(), strict=True)):
                    old = seen.get(k)
                    if old is None or (a, b) < old:
                        seen[k] = (a, b)
                        post[i] = True
                    else:
                        again[i] = (a, b) > old
                if len(seen) > ROOM:
                    seen = {}
                size = np.where(post, np.diff(own.at), 0)
                tokens = pj.packed_tokens(own.tokens[np.repeat(post, np.diff(own.at))], np.append(0, np.cumsum(size)))
                tokens = pc.if_else(pa.array(post), tokens, pa.scalar(None, pa.binary()))
                key = own.keys.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(place), row.take(pa.array(own.rows)), pa.array(own.numbers.astype(np.int32)), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(again), tokens], ["first", "row", "sub", "node", "other", "again", "tokens"])

    return docs.mapInArrow(work, _LINES)


def _place(id_column: Column) -> Column:
    """Ids in their order, null before all others; the least number of all is taken for a null."""
    return F.coalesce(id_column.cast("long"), F.lit(-(2**63)))


def repeated_lines(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Lines of docs (first, row, text) that have a similar line at an earlier place: first, row, sub; written."""
    table = written(_line_table(docs))
    sets = table.where("tokens IS NOT NULL").select("node", "other", "first", "sub", "tokens")
    levels = pj.order_levels(sets)
    found = written(pj.candidates(sets, levels, num, den).groupBy("x", "y").agg(F.max("more").alias("more")))
    late = written(pj.similar(sets, found.select("x", "y"), num, den))
    # sets that may have an earlier similar one besides those verified
    open_ = written(found.where("more").select(F.col("y").alias("node")).distinct().join(late, "node", "left_anti"))
    if not open_.isEmpty():
        rest = pj.candidates(sets, levels, num, den, pj.asking(sets, levels, num, den, open_)).select("x", "y").distinct()
        rest = written(rest.join(found, ["x", "y"], "left_anti"))
        late = written(late.union(pj.similar(sets, rest, num, den)).distinct())
    # what no task has met before is at most one row a task and set, so that windows are small
    key = ["node", "other"]
    least = F.min(F.struct("first", "sub")).over(Window.partitionBy(*key))
    own = table.where("NOT again").select(*key, "first", "row", "sub").withColumn("least", least)
    own = own.join(late.withColumn("late", F.lit(True)), key, "left").where(F.col("late") | (F.struct("first", "sub") > F.col("least")))
    gone = own.select("first", "row", "sub").union(table.where("again").select("first", "row", "sub"))
    out = written(gone.groupBy("first", "row").agg(F.collect_set("sub").alias("gone")))
    for done in (table, found, late, open_):
        drop(done)
    return out


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """One row for each document: id_column, n_lines, n_removed and text, its remaining lines.

    Lines are parts between line feeds.  A line goes if its word set has a Jaccard similarity of num / den or
    more with that of a line at an earlier place, places being ordered by id (an integer; null is least) and
    line number; whether the earlier line goes too plays no part.  Lines without words stay.  Of rows with equal
    ids neither line of equal number is earlier, so both stay unless an earlier one matches.  A null text has no
    lines and stays null; an empty one has one line and stays.  Texts may be as long as a row can be; an empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    text = F.col(text_column)
    df = docs.select(F.col(id_column).alias("id"), _place(F.col(id_column)).alias("first"), F.xxhash64(id_column, text_column).alias("row"), text.alias("text"))
    gone = repeated_lines(df.select("first", "row", "text"), num, den)
    # a row a document with lines to lose goes into a hash table, so that texts are not sorted
    out = df.join(gone.hint("shuffle_hash"), ["first", "row"], "left").withColumn("every", F.split("text", "\n", -1))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("every") - 1), "gone"), lambda i: F.get("every", i))
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n = F.coalesce(F.size("every"), F.lit(0))
    return out.select(F.col("id").alias(id_column), F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), left.alias("text"))

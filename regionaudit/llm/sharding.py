"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

All rows go to cells, the consecutive slot ranges of the shards, whose sizes are fixed beforehand.  How many
rows of each input partition go to each cell is drawn from the multivariate hypergeometric distribution that a
uniform permutation implies: the partitions form a binary tree, and every node's counts are split between its
halves by a generator seeded with the node, so that any task draws its own row of the matrix alone and a rerun
draws the same.  A task permutes its rows and deals them out; after the exchange each cell is permuted again
and its rows get the cell's slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import mix

SHARDS, SEED = 16, 42
#: Slots of a cell at least, and cells at most but for one a shard: each task draws a count for every cell.
CELL_ROWS, CELLS = 1 << 14, 1 << 16
#: numpy draws up to here; beyond, _inverted draws by the same law.
_NUMPY = 10**9


def _inverted(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw by inversion: weights around the mode from the ratios of neighbours, which are exact.

    What is over 12 standard deviations and 64 away from the mode weighs less than the rounding of the rest.
    """
    total = good + bad
    least, most, mode = max(0, n - bad), min(good, n), (good + 1) * (n + 1) // (total + 2)
    reach = int(12 * (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5) + 64
    low, high = max(least, mode - reach), min(most, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    ratio = (good - k) * (n - k) / ((k + 1) * (bad - n + k + 1))  # of k + 1 to k
    up, down = np.cumprod(ratio[mode - low :]), np.cumprod(1 / ratio[: mode - low][::-1])
    weights = np.cumsum(np.concatenate([down[::-1], [1.0], up]))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], "right"))


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    return int(rng.hypergeometric(good, bad, n)) if good + bad < _NUMPY else _inverted(rng, good, bad, n)


def split(rng: np.random.Generator, cells: np.ndarray, n: int) -> np.ndarray:
    """How many of each cell's slots fall to the first n rows."""
    out, left = np.zeros_like(cells), int(cells.sum())
    for i, c in enumerate(cells.tolist()):
        out[i] = _hypergeometric(rng, c, left - c, n)
        left, n = left - c, n - int(out[i])
    return out


def matrix_row(cells: np.ndarray, before: np.ndarray, part: int, seed: int) -> np.ndarray:
    """The row of partition ``part``; ``before``: rows before each partition, and all rows at its end."""
    low, high = 0, len(before) - 1
    while high - low > 1:
        middle = (low + high) // 2
        left = split(np.random.default_rng([seed, low, high]), cells, int(before[middle] - before[low]))
        low, high, cells = (low, middle, left) if part < middle else (middle, high, cells - left)
    return cells


def shard_cells(rows: int, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all cells, shard after shard, and the shard of each; shards differ by one row at most."""
    sizes, owner, most = [], [], max(CELL_ROWS, -(-rows // CELLS))
    for shard in range(shards):
        left = rows // shards + (shard < rows % shards)
        pieces = max(1, -(-left // most))
        sizes += [left // pieces + (i < left % pieces) for i in range(pieces)]
        owner += [shard] * pieces
    return np.array(sizes, np.int64), np.array(owner, np.int64)


def dealt(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """df as a struct column ``row``, with shard (0 to shards - 1) and slot (gapless from 0 in its shard), in a uniformly random order.

    Shard sizes differ by one row at most; empty tables give empty results; rows are not looked into, so nulls,
    ties, repeats, long texts and columns of any name are dealt like any others.  df must give the same partitions whenever it is run, as a scan
    does; a partition with another number of rows than counted stops the job.
    """
    spark = df.sparkSession
    counts = {r.part: r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()}
    per = np.array([counts.get(i, 0) for i in range(max(counts, default=-1) + 1)], np.int64)
    before = np.concatenate([[0], np.cumsum(per)])
    sizes, owner = shard_cells(int(before[-1]), shards)
    begins = np.cumsum(sizes) - sizes
    starts = begins - begins[np.searchsorted(owner, owner)]  # slot of a cell's first row
    shared = spark.sparkContext.broadcast((sizes, before, owner, starts))
    df = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    names = ["row"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, before, _, _ = shared.value
        part = TaskContext.get().partitionId()
        n = int(before[part + 1] - before[part]) if part + 1 < len(before) else 0
        rng = np.random.default_rng([seed, 1, part])
        cell = np.repeat(np.arange(len(sizes)), matrix_row(sizes, before, part, seed)) if n else np.empty(0, np.int64)
        rng.shuffle(cell)
        tag = mix(np.arange(n, dtype=np.uint64) + rng.integers(1 << 63, dtype=np.uint64)).view(np.int64)
        at = 0
        for batch in batches:
            end = at + batch.num_rows
            if end > n:
                raise RuntimeError(f"partition {part} has more than the {n} rows counted before")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell[at:end].astype(np.int32)), pa.array(tag[at:end])], [*names, "cell", "tag"])
            at = end
        if at != n:
            raise RuntimeError(f"partition {part} has {at} rows; {n} were counted before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, owner, starts = shared.value
        now, at = -1, 0
        for batch in batches:  # sorted by cell and tag
            cell = batch.column(len(names)).to_numpy().astype(np.int64)
            slot = np.empty(len(cell), np.int64)
            cuts = np.flatnonzero(np.diff(cell, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(cell)], strict=True):
                if cell[a] != now:
                    now, at = int(cell[a]), int(starts[cell[a]])
                slot[a:b] = np.arange(at, at + b - a)
                at += int(b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(owner[cell].astype(np.int32)), pa.array(slot)], [*names, "shard", "slot"])

    sent = df.mapInArrow(deal, T.StructType(list(df.schema.fields)).add("cell", T.IntegerType()).add("tag", T.LongType()))
    exchanged = sent.repartition(min(len(sizes), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))), "cell").sortWithinPartitions("cell", "tag")
    return exchanged.mapInArrow(place, T.StructType(list(df.schema.fields)).add("shard", T.IntegerType()).add("slot", T.LongType()))


def shuffled_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs with their shard and slot (see dealt); where docs has a column of such a name, ``_`` follows the new one's."""
    names: list[str] = []
    for name in ("shard", "slot"):
        while name.lower() in {c.lower() for c in docs.columns}:
            name += "_"
        names.append(name)
    return dealt(docs, shards, seed).select("row.*", F.col("shard").alias(names[0]), F.col("slot").alias(names[1]))


def shard_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row for each document: id_column, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1 (a null text has none); text_crc32 of a null text is that of an empty
    one, 0.  The law is ``rows``; grown_shard is null.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    slim = docs.select(F.col(id_column).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("crc"))
    out = dealt(slim, shards, seed)
    return out.select(F.col("row.id").alias(id_column), "row.size", F.col("row.crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

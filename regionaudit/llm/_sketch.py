"""Fixed-size sketches of a whole table, counted on the executors and small enough to broadcast at any size.

They only steer work (an order, a pre-filter); where a sketch is too coarse the work grows, never the error.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PARTS = 64
_ROWS = "part int, at binary, n binary"


def bucket_sums(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, least: int, to_bytes: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Counts the hashes of df's rows in 2**bits buckets and returns ``to_bytes`` of the counts.

    A task reports the buckets in which it counted ``least`` or more: one bounded message for each task
    and part, however often a hash comes up.
    """
    width = (1 << bits) // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, held, n = np.empty(0, np.uint32), np.empty(0, np.int64), [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            new, many = np.unique(np.concatenate(held), return_counts=True)
            every, place = np.unique(np.concatenate([at, new]), return_inverse=True)
            return every, np.bincount(place, np.concatenate([total, many]), len(every)).astype(np.int64)

        for batch in batches:
            for h in hashes(batch):
                held.append((h & np.uint64((1 << bits) - 1)).astype(np.uint32))
                n += len(h)
                if n > 1 << 20:
                    at, total = summed()
                    held, n = [], 0
        if held:
            at, total = summed()
        at, total = at[total >= least], total[total >= least].astype(np.uint32)
        cuts = np.searchsorted(at, np.arange(PARTS + 1) * width)
        for p in range(PARTS):
            own = at[cuts[p] : cuts[p + 1]]
            if len(own):
                yield pa.RecordBatch.from_pylist([{"part": p, "at": own.tobytes(), "n": total[cuts[p] : cuts[p + 1]].tobytes()}], pa.schema([("part", pa.int32()), ("at", pa.binary()), ("n", pa.binary())]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                total = parts.setdefault(row["part"], np.zeros(width, np.int64))
                total[np.frombuffer(row["at"], np.uint32) - row["part"] * width] += np.frombuffer(row["n"], np.uint32)
        for p, total in parts.items():
            yield pa.RecordBatch.from_pylist([{"part": p, "at": to_bytes(total).tobytes(), "n": b""}], pa.schema([("part", pa.int32()), ("at", pa.binary()), ("n", pa.binary())]))

    empty = to_bytes(np.zeros(width, np.int64))
    out = np.tile(empty, PARTS)
    for row in df.mapInArrow(count, _ROWS).repartition(_tasks(df), "part").mapInArrow(add, _ROWS).collect():
        out[row["part"] * len(empty) : (row["part"] + 1) * len(empty)] = np.frombuffer(row["at"], np.uint8)
    return out


def _tasks(df: DataFrame) -> int:
    """As many tasks add parts up as the cluster's shuffles call for."""
    return min(PARTS, max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def _summed(df: DataFrame, total: Callable[[Iterator[pa.RecordBatch]], np.ndarray], bits: int, sent_as: str, kind: str, merge: np.ufunc) -> np.ndarray:
    """One dense array of 2**bits buckets a task, sent in compressed parts, which are merged by part as ``kind``."""
    width = (1 << bits) // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = total(batches)
        raw = [zlib.compress(every[p * width : (p + 1) * width].tobytes(), 1) for p in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(raw, pa.binary())], ["part", "raw"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:  # sorted by part
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(raw), sent_as).astype(kind)
                if part == now:
                    merge(held, own, out=held)
                    continue
                if now is not None:
                    yield sent(now, held)
                now, held = part, own
        if now is not None:
            yield sent(now, held)

    def sent(part: int, held: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(held.tobytes(), 1)], pa.binary())], ["part", "raw"])

    out, schema = np.zeros(1 << bits, kind), "part int, raw binary"
    for row in df.mapInArrow(count, schema).repartition(_tasks(df), "part").sortWithinPartitions("part").mapInArrow(add, schema).collect():
        out[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(zlib.decompress(row["raw"]), kind)
    return out


def dense_counts(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """How many of all hashes of df's rows fall in each bucket."""

    def total(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out, held, n = np.zeros(1 << bits, np.uint32), [], 0
        mask = np.uint64((1 << bits) - 1)

        def add() -> None:
            out[:] += np.bincount((np.concatenate(held) & mask).astype(np.int64), minlength=1 << bits).astype(np.uint32)

        for batch in batches:
            held.append(hashes(batch))
            n += len(held[-1])
            if n > 1 << 21:
                add()
                held, n = [], 0
        if held:
            add()
        return out

    return _summed(df, total, bits, "<u4", "<u8", np.add)


def bucket_bits(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """A bitmap of the buckets that the hashes of df's rows fall in (see in_bitmap)."""

    def total(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(1 << bits, bool)
        for batch in batches:
            out[(hashes(batch) & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
        return np.packbits(out, bitorder="little")

    return _summed(df, total, bits - 3, "u1", "u1", np.bitwise_or)


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale, four steps to a doubling."""
    return np.minimum(np.round(4 * np.log2(counts + 1)), 255).astype(np.uint8)


def bitmap(counts: np.ndarray) -> np.ndarray:
    return np.packbits(counts > 0, bitorder="little")


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

"""Exact set-similarity joins over sets of 64-bit hashes that are made from a table's rows.

Sets are told apart by a 16-byte key; its first half, the node, stands for a set until candidates are
verified, and verification goes by whole keys.  Equal sets are one set from the first task on.

Candidates: a set of n hashes in any fixed order has, for similarity t, n - ceil(t n) + 1 leading hashes,
and similar sets share one of them.  The order puts hashes in frequent buckets of a fixed-size sketch
last.  Leading hashes travel as packed arrays, one for each batch and block of hashes.  In a block, the
lists of sets under each hash are cut by size and position bounds.  Short lists give all their pairs;
long ones give a linear number of pairs, and their members are kept in a table ("wide"), from which the
caller takes whatever further pairs its result needs: nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _sketch
from ._scratch import drop, written
from ._text import binary16, keys, mix

#: A list this long or shorter gives all its pairs.
SHORT = 8
#: Of a long list sorted by size, every set is paired with the first of each run of so many.
RUN = 64
ORDER_BITS, FILTER_BITS = 24, 25

#: From a batch: lists of sets.
Sets = Callable[[pa.RecordBatch], Iterator[list[np.ndarray]]]

_POSTING = np.dtype([("h", "<u4"), ("node", "<u8"), ("n", "<u4"), ("pos", "<u4")])


def order_levels(df: DataFrame, sets: Sets, least: int = 3) -> np.ndarray:
    """How frequent hashes are, by bucket; ``least``: see _sketch.bucket_sums."""

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for own in sets(batch):
            if own:
                yield np.concatenate(own)

    return _sketch.bucket_sums(df, hashes, ORDER_BITS, least, _sketch.levels)


def leading(s: np.ndarray, levels: np.ndarray, num: int, den: int) -> np.ndarray:
    n = len(s) - -(-num * len(s) // den) + 1
    rare = levels[s & np.uint64(len(levels) - 1)]
    if not rare.any():
        return s[:n]
    return s[np.argsort(rare, kind="stable")[:n]]


def _distinct(batches: Iterator[pa.RecordBatch], sets: Sets, room: int = 1 << 20) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The sets of a task, with their keys, without repeats (of the last ``room`` sets or so)."""
    seen: set[int] = set()
    for batch in batches:
        for own in sets(batch):
            k = keys(own)
            keep = []
            for i, (s, node) in enumerate(zip(own, k[:, 0].tolist(), strict=True)):
                if len(s) and node not in seen:
                    seen.add(node)
                    keep.append(i)
            if len(seen) > room:
                seen = set()
            if keep:
                yield [own[i] for i in keep], k[keep]


def candidates(df: DataFrame, sets: Sets, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """Candidate pairs (kind 0: x, y, nodes) and members of long lists (kind 1: x node, y list, n, pos, and the list's length)."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = 4 * parts
    shared = spark.sparkContext.broadcast(levels)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def packed() -> pa.RecordBatch:
            every, block = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(block, kind="stable")
            every, block = every[order], block[order]
            at = np.flatnonzero(np.diff(block, prepend=-1))
            raw = [every[a:b].tobytes() for a, b in zip(at, [*at[1:], len(block)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(block[at], pa.int32()), pa.array(raw, pa.binary())], ["block", "packed"])

        for own, k in _distinct(batches, sets):
            for i, s in enumerate(own):
                lead = leading(s, shared.value, num, den)
                rows = np.empty(len(lead), _POSTING)
                rows["h"], rows["node"], rows["n"], rows["pos"] = lead >> np.uint64(32), k[i, 0], len(s), np.arange(len(lead))
                held.append((rows, (lead % np.uint64(blocks)).astype(np.int64)))
                n += len(lead)
            if n > 1 << 18:
                yield packed()
                held, n = [], 0
        if held:
            yield packed()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(block, []).append(raw)
        while by:
            block, raws = by.popitem()
            yield from _block(block, np.frombuffer(b"".join(raws), _POSTING), num, den)

    packed = df.mapInArrow(post, "block int, packed binary").repartition(parts, "block")
    return packed.mapInArrow(join, "kind int, x long, y long, n long, pos long, length long")


def _pairs_ok(p: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """By size and position bounds, could rows a and b of p be similar?"""
    na, nb = p["n"][a].astype(np.int64), p["n"][b].astype(np.int64)
    pa_, pb = p["pos"][a].astype(np.int64), p["pos"][b].astype(np.int64)
    most = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_, nb - pb) - 1
    near = p["node"][a] != p["node"][b]
    return near & (num * np.maximum(na, nb) <= den * np.minimum(na, nb)) & ((num + den) * most >= num * (na + nb))


def _block(block: int, p: np.ndarray, num: int, den: int) -> Iterator[pa.RecordBatch]:
    p = p[np.lexsort((p["node"], p["h"]))]
    new = np.ones(len(p), bool)
    new[1:] = (p["h"][1:] != p["h"][:-1]) | (p["node"][1:] != p["node"][:-1])
    p = p[new]
    p = p[np.lexsort((p["node"], p["n"], p["h"]))]
    starts = np.flatnonzero(np.diff(p["h"].astype(np.int64), prepend=-1))
    lengths = np.diff(np.append(starts, len(p)))
    where, length = np.repeat(starts, lengths), np.repeat(lengths, lengths)
    at = np.arange(len(p))
    one, two = [], []
    some = np.flatnonzero(length <= SHORT)
    for d in range(1, SHORT):
        some = some[(at - where)[some] >= d]
        if not len(some):
            break
        one.append(some - d), two.append(some)
    wide = np.flatnonzero(length > SHORT)
    for d in (1, 2):
        a = wide[(at - where)[wide] >= d]
        one.append(a - d), two.append(a)
    one.append((wide - (wide - where[wide]) % RUN)), two.append(wide)
    later = wide[(wide - where[wide]) % RUN == 0]
    later = later[later > where[later]]
    one.append(later - RUN), two.append(later)
    a, b = np.concatenate(one), np.concatenate(two)
    ok = _pairs_ok(p, a, b, num, den)
    x, y = p["node"][a[ok]].view(np.int64), p["node"][b[ok]].view(np.int64)
    pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
    zero = np.zeros(len(pair), np.int64)
    yield _rows(np.zeros(len(pair), np.int32), pair[:, 0], pair[:, 1], zero, zero, zero)
    if len(wide):
        w = p[wide]
        list_id = mix(w["h"].astype(np.uint64) | np.uint64(block << 32)).view(np.int64)
        yield _rows(np.ones(len(w), np.int32), np.ascontiguousarray(w["node"]).view(np.int64), list_id, w["n"].astype(np.int64), w["pos"].astype(np.int64), length[wide])


def _rows(*cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "x", "y", "n", "pos", "length"])


def parity_bits(s: np.ndarray, most: int = 1 << 62) -> bytes:
    """A bitmap of as many bits as the set has hashes or more, unless over ``most``: bit i tells whether an odd number of hashes end in i."""
    b = min(most, max(64, 1 << (len(s) - 1).bit_length()))
    return np.packbits(np.bincount((s & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1, bitorder="little").tobytes()


def possible(pairs: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) that bitmaps don't rule out; bits: node, n, bits, one row a node.

    Bitmaps of two sets differ in no more bits than the sets have hashes in one of them only, so they bound the
    overlap from above; a pair whose bound is under what its sizes ask for is discarded.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for i, (nx, a, ny, b) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                while len(a) > len(b):
                    a = a[: len(a) // 2] ^ a[len(a) // 2 :]
                while len(b) > len(a):
                    b = b[: len(b) // 2] ^ b[len(b) // 2 :]
                most = (nx + ny - int(np.bitwise_count(a ^ b).sum())) // 2
                if (num + den) * most >= num * (nx + ny):
                    ok.append(i)
            yield batch.select([0, 1]).take(pa.array(ok, pa.int64()))

    one = pairs.join(bits.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("bits").alias("bx")), "x")
    two = one.join(bits.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("bits").alias("by")), "y")
    return written(two.select("x", "y", "nx", "bx", "ny", "by").mapInArrow(keep, "x long, y long"))


#: Members of a long list that are compared in one group; longer lists are cut into tiles, compared two by two.
TILE = 4096
#: Bits of the bitmaps that go with every membership; and so many lists of a set are named in it.
SMALL_BITS, NAMED = 4096, 16


def remaining(wide: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (x, y) of members of one long list that have different labels and that size, position and bitmap allow.

    wide: list, x, n, pos, length (of the list) and label.  bits: node, small.  A pair that several lists share comes
    from the least of them; where that can't be told from the few lists named in a row, from all, and repeats go afterwards.
    """
    parts = max(1, int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lists = wide.groupBy("x").agg(F.slice(F.sort_array(F.collect_set("list")), 1, NAMED).alias("lists"))
    nodes = lists.join(bits.select(F.col("node").alias("x"), F.col("small").alias("bits")), "x")
    rows = wide.select("list", "x", "n", "pos", F.xxhash64("label").alias("label"), F.ceil(F.col("length") / TILE).cast("int").alias("tiles"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("x"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("list", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "x", "n", "pos", "label").join(nodes, "x")
    rows = rows.select("list", "a", "b", "tile", "x", "n", "pos", "label", "bits", "lists").repartition(parts, "list", "a", "b").sortWithinPartitions("list", "a", "b", "n")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != now:
                    if len(held) > 1:
                        yield _compared(held, num, den)
                    now, held = row[:3], []
                held.append((*row[3:], row[0]))
        if len(held) > 1:
            yield _compared(held, num, den)

    return rows.mapInArrow(compare, "x long, y long").distinct()


def _compared(held: list[tuple], num: int, den: int) -> pa.RecordBatch:
    tile, x, n, pos, label = (np.array([h[k] for h in held], np.int64) for k in range(5))
    raw = [np.frombuffer(h[5], np.uint8) for h in held]
    at_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for width in {len(b) for b in raw}:
        own = [i for i, b in enumerate(raw) if len(b) in (width, 2 * width)]
        matrix = np.stack([raw[i] if len(raw[i]) == width else raw[i][:width] ^ raw[i][width:] for i in own])
        at_width[width] = np.array(own), matrix
    one, two = [], []
    shared, crossed = held[0][7], tile.min() != tile.max()
    for i in range(len(held) - 1):
        own, matrix = at_width[len(raw[i])]
        j = slice(np.searchsorted(own, i, "right"), np.searchsorted(own, np.searchsorted(n, n[i] * den // num, "right")))
        c = own[j]
        most = np.minimum(pos[c], pos[i]) + np.minimum(n[c] - pos[c], n[i] - pos[i])
        ok = np.flatnonzero((label[c] != label[i]) & (x[c] != x[i]) & ((num + den) * most >= num * (n[c] + n[i])))
        ok = ok[tile[c[ok]] != tile[i]] if crossed else ok
        if not len(ok):
            continue
        apart = np.bitwise_count(matrix[j][ok] ^ raw[i]).sum(axis=1, dtype=np.int64)
        for k in c[ok[(num + den) * ((n[c[ok]] + n[i] - apart) // 2) >= num * (n[c[ok]] + n[i])]].tolist():
            common = np.intersect1d(held[i][6], held[k][6], assume_unique=True)
            if not len(common) or common[0] == shared:
                one.append(min(int(x[i]), int(x[k])))
                two.append(max(int(x[i]), int(x[k])))
    return pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["x", "y"])


def verified(df: DataFrame, sets: Sets, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs of nodes (x, y: written, distinct, best few), the similar ones as keys (x, y)."""
    spark = df.sparkSession
    nodes = pairs.select(F.explode(F.array("x", "y")).alias("node"))
    bits = _sketch.bucket_sums(nodes, lambda b: iter([mix(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))]), FILTER_BITS, 1, _sketch.bitmap)
    shared = spark.sparkContext.broadcast(bits)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, k in _distinct(batches, sets):
            keep = np.flatnonzero(_sketch.in_bitmap(shared.value, mix(k[:, 0])))
            for low in range(0, len(keep), 256):
                part = keep[low : low + 256]
                yield pa.RecordBatch.from_arrays([pa.array(k[part, 0].view(np.int64)), binary16(k[part]), pa.array([own[i].tobytes() for i in part], pa.binary())], ["node", "key", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, (a, b) in enumerate(zip(left, right, strict=True)):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if den * both >= num * (len(a) + len(b) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    held = written(df.mapInArrow(arrays, "node long, key binary, s binary").dropDuplicates(["node", "key"]))
    one = pairs.join(held.select(F.col("node").alias("x"), F.col("key").alias("kx"), F.col("s").alias("sx")), "x")
    two = one.join(held.select(F.col("node").alias("y"), F.col("key").alias("ky"), F.col("s").alias("sy")), "y")
    out = written(two.select(F.least("kx", "ky").alias("x"), F.greatest("kx", "ky").alias("y"), F.when(F.col("kx") < F.col("ky"), F.col("sx")).otherwise(F.col("sy")).alias("sx"), F.when(F.col("kx") < F.col("ky"), F.col("sy")).otherwise(F.col("sx")).alias("sy")).mapInArrow(compare, "x binary, y binary"))
    drop(held)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (x, y): every node that has an edge, with its component's least node as label.

    Each task first contracts its own edges; then large-star and small-star rounds, each written out, until
    nothing changes: a number of rounds logarithmic in the longest path.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[bytes, bytes] = {}

        def top(v: bytes) -> bytes:
            root = v
            while up.get(root, root) != root:
                root = up[root]
            while up.get(v, v) != root:
                up[v], v = root, up.get(v, v)
            return root

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(x), top(y)
                up.setdefault(x, x), up.setdefault(y, y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        star = [(v, top(v)) for v in up if top(v) != v]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in star], pa.binary()), pa.array([b for _, b in star], pa.binary())], ["v", "m"])

    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
    stars = written(edges.select("x", "y").mapInArrow(contract, "v binary, m binary").distinct())
    before = mark(stars)
    while True:
        both = stars.union(stars.select("m", "v"))
        least = both.groupBy("v").agg(F.min("m").alias("least")).withColumn("least", F.least("v", "least"))
        large = both.where(F.col("m") > F.col("v")).join(least, "v").select(F.col("m").alias("v"), F.col("least").alias("m"))
        lower = large.groupBy("v").agg(F.min("m").alias("least"))
        small = large.join(lower, "v").where(F.col("m") != F.col("least")).select(F.col("m").alias("v"), F.col("least").alias("m")).union(lower)
        new = written(small.distinct())
        after = mark(new)
        drop(stars)
        stars, same, before = new, after == before, after
        if same:
            return stars.select(F.col("v").alias("node"), F.col("m").alias("label")).union(stars.select("m", "m").distinct())

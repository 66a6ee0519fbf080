"""Candidates of the line join: sets of words that share leading (rare) words.

A set of n words in a global order, rare words first, that has a similarity of t with another shares one of its
n - ceil(t n) + 1 leading words with it, and two of one more.  A word of up to FREQUENT sets makes a list of its own; a
more frequent one only together with a later leading word, as all words behind it in a set are at least as frequent.  In a
list, sets are compared by size, position of the shared word and a 128-bit parity bitmap.  What is asked of each set is
only whether an earlier similar one exists, so that a set found to be very near to an early one of its list (a pivot)
waits for its verification; one that has been verified in vain is compared with all its lists in full (``asked``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _sketch
from ._text import mix

U = np.uint64
TOKEN_BYTES, ORDER_BITS, FILTER_BITS = 5, 22, 25
#: A word of more sets than this doesn't make lists alone.
FREQUENT = 4096
#: Lists from this length on have pivots, and so many of them.
LONG, PIVOTS = 64, 8
#: Candidates that a set has from a list at first; if none is similar, and there are more, it is compared in full.
NAMED = 8
#: Pairs that are compared at a time, and postings that travel together.
PAIRS, TOGETHER = 1 << 21, 1 << 18
_LOW32 = U((1 << 32) - 1)
_FIELDS = (("h", "<u4"), ("n", "<u4"), ("pos", "<u4"), ("sub", "<u4"), ("node", "<i8"), ("first", "<i8"), ("bits", "<u8"), ("more", "<u8"))
_WIDTH = sum(np.dtype(t).itemsize for _, t in _FIELDS)


def packed_tokens(tokens: np.ndarray, at: np.ndarray) -> pa.Array:
    """The last 40 bits of the word hashes of sets, as binaries."""
    raw = np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES])
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * TOKEN_BYTES).astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def unpacked_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all sets of a column without nulls, and where each set begins."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, TOKEN_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :TOKEN_BYTES] = raw
    return out.view("<u8").reshape(-1), (offsets - offsets[0]) // TOKEN_BYTES


def _apart(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many words similar sets of s words together have in one of them only, at most."""
    return s - 2 * -(-num * s // (num + den))


def order_levels(sets: DataFrame) -> np.ndarray:
    """In how many sets the words of each bucket are, on a logarithmic scale; sets: tokens."""
    return _sketch.levels(_sketch.dense_counts(sets.select("tokens"), lambda b: unpacked_tokens(b.column(0))[0], ORDER_BITS))


def _postings(tokens: np.ndarray, at: np.ndarray, levels: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, set, position and first word of each posting of some sets (under 2**24)."""
    n = np.diff(at)
    own = np.repeat(np.arange(len(n)), n)
    level = levels[tokens & U(len(levels) - 1)].astype(U)
    packed = np.sort(own.astype(U) << U(40) | level << U(32) | (tokens & _LOW32))
    word, pos = packed & U((1 << 40) - 1), np.arange(len(packed)) - at[own]
    # sets so small that no other set is similar have no postings
    lead = np.where(_apart(n + n * den // num, num, den) > 0, n - -(-num * n // den) + 1, 0)[own]
    frequent = (word >> U(32)) > U(_sketch.levels(np.array([FREQUENT]))[0])
    single = (word >> U(32)) <= U(_sketch.levels(np.array([1]))[0])  # in no other set, as its bucket has one word of one set
    alone = np.flatnonzero((pos < lead) & ~frequent & ~single)
    keys, where = [mix(word[alone])], [alone]
    first = np.flatnonzero((pos < lead) & frequent)
    step = 1
    while len(first):  # a frequent word with each later one of the leading words, and one more
        first = first[pos[first] + step < np.minimum(lead[first] + 1, n[own[first]])]
        keys.append(mix(mix(word[first] + U(1)) + word[first + step]))
        where.append(first)
        step += 1
    place = np.concatenate(where)
    return np.concatenate(keys), own[place], pos[place], word[place]


def _of_word(word: np.ndarray) -> np.ndarray:
    return mix((word & _LOW32) + U(1 << 40))


def candidates(sets: DataFrame, levels: np.ndarray, num: int, den: int, asked: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Candidate pairs x, y (nodes, x the earlier) and whether y may have more; sets: node, first, sub, tokens.

    ``asked`` (bitmaps of nodes and of keys, see asking): all pairs of the asked nodes, and of no others.
    """
    spark = sets.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = 16 * parts
    shared = spark.sparkContext.broadcast((levels, asked))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, asked = shared.value
        held: list[tuple] = []
        n = 0

        def packed() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            order = np.lexsort((columns[1], columns[0]))
            columns = [c[order] for c in columns]
            cuts = np.flatnonzero(np.diff(columns[0], prepend=-1))
            # byte by byte, so that Spark's compression finds the zeros of small numbers
            raw = [b"".join(c[a:b].view(np.uint8).reshape(b - a, -1).T.tobytes() for c in columns[1:]) for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0][cuts], pa.int32()), pa.array(raw, pa.binary())], ["block", "packed"])

        for batch in batches:
            node, first, sub = (batch.column(i).to_numpy() for i in range(3))
            tokens, at = unpacked_tokens(batch.column(3))
            if asked is not None and len(tokens):  # sets without any of the words go early
                some = np.logical_or.reduceat(_sketch.in_bitmap(asked[1], _of_word(tokens)), at[:-1])
                node, first, sub = node[some], first[some], sub[some]
                tokens, at = tokens[np.repeat(some, np.diff(at))], np.append(0, np.cumsum(np.diff(at)[some]))
            if not len(tokens):
                continue
            key, own, pos = _postings(tokens, at, levels, num, den)[:3]
            if asked is not None:
                keep = _sketch.in_bitmap(asked[1], key)
                key, own, pos = key[keep], own[keep], pos[keep]
            bit, half = U(1) << (tokens >> U(34) & U(63)), tokens >> U(33) & U(1)
            bits, rest = (np.bitwise_xor.reduceat(bit * x, at[:-1]) for x in (U(1) - half, half))
            column = {"h": key >> U(32), "n": np.diff(at)[own], "pos": pos, "sub": sub[own], "node": node[own], "first": first[own], "bits": bits[own], "more": rest[own]}
            held.append(((key % U(blocks)).astype(np.int32), *(column[k].astype(t) for k, t in _FIELDS)))
            n += len(key)
            if n > TOGETHER:
                yield packed()
                held, n = [], 0
        if n:
            yield packed()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value[1]
        now, raws = None, []
        for batch in batches:  # sorted by block
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != now and raws:
                    yield from _block(raws, num, den, asked)
                    raws = []
                now = block
                raws.append(raw)
        if raws:
            yield from _block(raws, num, den, asked)

    packed = sets.select("node", "first", "sub", "tokens").mapInArrow(post, "block int, packed binary")
    return packed.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(join, "x long, y long, more boolean")


def asking(sets: DataFrame, levels: np.ndarray, num: int, den: int, nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of some nodes, and one of the keys of their lists and of the words that these begin with."""
    own = _sketch.bucket_bits(nodes, lambda b: mix(b.column(0).to_numpy().view(U)), FILTER_BITS)
    shared = sets.sparkSession.sparkContext.broadcast((own, levels))

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        own, levels = shared.value
        some = batch.filter(pa.array(_sketch.in_bitmap(own, mix(batch.column(0).to_numpy().view(U)))))
        if not len(some):
            return np.empty(0, U)
        key, _, _, word = _postings(*unpacked_tokens(some.column(1)), levels, num, den)
        return np.concatenate([key, _of_word(word)])

    return own, _sketch.bucket_bits(sets.select("node", "tokens"), keys, FILTER_BITS)


def _block(raws: list[bytes], num: int, den: int, asked: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    parts = {k: [] for k, _ in _FIELDS}
    for raw in raws:
        at, n = 0, len(raw) // _WIDTH
        for k, t in _FIELDS:
            width = np.dtype(t).itemsize
            parts[k].append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(t).reshape(-1))
            at += n * width
    p = {k: np.concatenate(x) for k, x in parts.items()}
    # lists of one set first: most are
    order = np.argsort(p["h"], kind="stable")
    same = p["h"][order][1:] == p["h"][order][:-1]
    order = order[np.append(same, False) | np.insert(same, 0, False)]
    p = {k: x[order] for k, x in p.items()}
    if not len(order):
        return
    order = np.lexsort((p["sub"], p["first"], p["node"], p["h"]))  # of a set's repeats, the first place
    p = {k: x[order] for k, x in p.items()}
    new = np.append(True, (p["h"][1:] != p["h"][:-1]) | (p["node"][1:] != p["node"][:-1]))
    p = {k: x[new] for k, x in p.items()}
    order = np.lexsort((p["n"], p["h"]))
    p = {k: x[order].astype(np.int64) if k in ("h", "n", "pos", "sub") else x[order] for k, x in p.items()}
    p["rank"] = _ranks(p["first"], p["sub"])
    if asked is None:
        yield _earliest(p, num, den)
    else:
        asks = _sketch.in_bitmap(asked[0], mix(p["node"].view(U)))
        for a, b in _windows(p, np.flatnonzero(asks), num, den, both=True):
            keep = p["rank"][b] < p["rank"][a]
            yield _pairs(p, b[keep], a[keep], np.zeros(int(keep.sum()), bool))


def _ranks(first: np.ndarray, sub: np.ndarray) -> np.ndarray:
    order = np.lexsort((sub, first))
    f, s = first[order], sub[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.append(False, (f[1:] != f[:-1]) | (s[1:] != s[:-1])))
    return out


def _pairs(p: dict, x: np.ndarray, y: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(p["node"][x]), pa.array(p["node"][y]), pa.array(more)], ["x", "y", "more"])


def _may(p: dict, a: np.ndarray, b: np.ndarray, num: int, den: int, share: int = 1) -> np.ndarray:
    """Could rows a and b be similar, by bitmap, size and position?  With ``share``: by so much of what may differ."""
    s = p["n"][a] + p["n"][b]
    most = _apart(s, num, den) // share
    ok = np.flatnonzero(np.bitwise_count(p["bits"][a] ^ p["bits"][b]) <= most)
    x, y = a[ok], b[ok]
    ok = ok[np.bitwise_count(p["bits"][x] ^ p["bits"][y]) + np.bitwise_count(p["more"][x] ^ p["more"][y]) <= most[ok]]
    x, y = a[ok], b[ok]
    nx, ny, px, py = p["n"][x], p["n"][y], p["pos"][x], p["pos"][y]
    most = np.minimum(px, py) + np.minimum(nx - px, ny - py)
    fine = (num * np.maximum(nx, ny) <= den * np.minimum(nx, ny)) & ((num + den) * most >= num * s[ok])
    out = np.zeros(len(a), bool)
    out[ok] = fine
    return out


def _windows(p: dict, rows: np.ndarray, num: int, den: int, both: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and those of their lists that may be similar: larger ones, or also smaller and equal ones with ``both``."""
    size = p["h"] * (int(p["n"].max()) + 1) + p["n"]  # rows are in this order
    span, n = p["h"][rows] * (int(p["n"].max()) + 1), p["n"][rows]
    high = np.searchsorted(size, span + np.minimum(n * den // num, p["n"].max()), "right")
    low = np.searchsorted(size, span - (-num * n // den), "left") if both else rows + 1
    some = np.flatnonzero(high > low)
    rows, low, many = rows[some], low[some], (high - low)[some]
    upto = np.cumsum(many)
    i = 0
    while i < len(rows):
        k = max(i + 1, int(np.searchsorted(upto, upto[i] - many[i] + PAIRS, "right")))
        a = np.repeat(rows[i:k], many[i:k])
        b = np.arange(len(a)) + np.repeat(low[i:k] - (upto[i:k] - many[i:k] - (upto[i] - many[i])), many[i:k])
        ok = _may(p, a, b, num, den) & (a != b)
        if ok.any():
            yield a[ok], b[ok]
        i = k


def _earliest(p: dict, num: int, den: int) -> pa.RecordBatch:
    """For each set of a list the earliest ones that may be similar; what is very near to a pivot has that one only."""
    rows, rank = len(p["h"]), p["rank"]
    starts = np.flatnonzero(np.append(True, p["h"][1:] != p["h"][:-1]))
    lengths = np.diff(np.append(starts, rows))
    best, more = np.full(rows, -1), np.zeros(rows, bool)
    late = np.iinfo(np.int64).max
    long = np.flatnonzero(np.repeat(lengths >= LONG, lengths))
    if len(long):
        heads, sizes = np.flatnonzero(np.append(True, p["h"][long][1:] != p["h"][long][:-1])), lengths[lengths >= LONG]
        used = np.zeros(len(long), bool)
        for _ in range(PIVOTS):
            open_ = np.where(used | (best[long] >= 0), late, rank[long])
            least = np.repeat(np.minimum.reduceat(open_, heads), sizes)
            at = np.where((open_ == least) & (open_ < late), np.arange(len(long)), len(long))
            pivot = np.repeat(np.minimum.reduceat(at, heads), sizes)
            some = np.flatnonzero((pivot < len(long)) & (best[long] < 0))
            if not len(some):
                break
            used[np.unique(pivot[some])] = True
            a, b = long[pivot[some]], long[some]
            near = (rank[a] < rank[b]) & _may(p, a, b, num, den, share=2)
            best[b[near]], more[b[near]] = a[near], True
    waits = np.flatnonzero(best >= 0)
    busy = np.repeat(np.add.reduceat(best >= 0, starts) > 0, lengths)
    kept, new, held = [best[waits], waits], [], 0

    def reduced() -> list[np.ndarray]:
        """Of each set's candidates the first NAMED; what has more is marked."""
        x, y = (np.concatenate(c) for c in zip(kept, *new, strict=True))
        order = np.lexsort((x, rank[x], y))
        x, y = x[order], y[order]
        fresh = np.append(True, (y[1:] != y[:-1]) | (x[1:] != x[:-1])) if len(y) else np.empty(0, bool)
        x, y = x[fresh], y[fresh]
        heads = np.flatnonzero(np.append(True, y[1:] != y[:-1])) if len(y) else np.empty(0, np.int64)
        at = np.arange(len(y)) - np.repeat(heads, np.diff(np.append(heads, len(y))))
        more[y[at >= NAMED]] = True
        return [x[at < NAMED], y[at < NAMED]]

    for todo, both in ((np.flatnonzero(~busy), False), (np.flatnonzero(busy & (best < 0)), True)):
        for a, b in _windows(p, todo, num, den, both) if len(todo) else ():
            x, y = (b, a) if both else (np.where(rank[a] < rank[b], a, b), np.where(rank[a] < rank[b], b, a))
            keep = rank[x] < rank[y]
            new.append((x[keep], y[keep]))
            held += len(new[-1][0])
            if held > PAIRS + len(kept[0]):
                kept, new, held = reduced(), [], 0
    x, y = reduced()
    return _pairs(p, x, y, more[y])


def similar(sets: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs of nodes (x, y) the similar sets: for each such pair the later set's whole key, node and other.

    sets: node, other, first, sub, tokens.  Of sets at one place neither is later.
    """
    bits = _sketch.bucket_bits(pairs.select(F.explode(F.array("x", "y")).alias("node")), lambda b: mix(b.column(0).to_numpy().view(U)), FILTER_BITS)
    shared = sets.sparkSession.sparkContext.broadcast(bits)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_sketch.in_bitmap(shared.value, mix(batch.column(0).to_numpy().view(U)))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 1 << 14):
                some = batch.slice(low, 1 << 14)
                (a, at_a), (b, at_b) = unpacked_tokens(some.column(2)), unpacked_tokens(some.column(3))
                n = np.diff(at_a) + np.diff(at_b)
                owner = np.concatenate([np.repeat(np.arange(len(some)), np.diff(x)) for x in (at_a, at_b)])
                every = np.sort(owner.astype(U) << U(48) | np.concatenate([a, b]))
                both = np.bincount((every[1:][every[1:] == every[:-1]] >> U(48)).astype(np.int64), minlength=len(some))
                yield some.select([0, 1]).filter(pa.array(den * both >= num * (n - both)))

    held = sets.select("node", "other", "first", "sub", "tokens").mapInArrow(met, "node long, other long, first long, sub int, tokens binary")
    held = held.groupBy("node", "other").agg(F.min(F.struct("first", "sub")).alias("place"), F.max("tokens").alias("tokens"))
    x, y = (F.struct("place", "node", "other", "tokens").alias(s) for s in "xy")
    one = pairs.withColumnsRenamed({"x": "a", "y": "b"}).join(held.select(F.col("node").alias("a"), x), "a")
    two = one.join(held.select(F.col("node").alias("b"), y), "b").where("x.place <> y.place")
    later = F.when(F.col("x.place") > F.col("y.place"), F.col("x")).otherwise(F.col("y"))
    return two.select(later.alias("l"), "x.tokens", F.col("y.tokens").alias("others")).select("l.node", "l.other", "tokens", "others").mapInArrow(compare, "node long, other long").distinct()

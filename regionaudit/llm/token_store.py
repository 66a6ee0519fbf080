"""Token ids as a binary store: a static range asymmetric numeral system (rANS).

A store is a Parquet table of segments in ascending order of document id.  A segment holds whole documents,
one frequency table shared by its blocks, and the blocks: BLOCK ids each, coded by LANES interleaved states
into one stream of 32-bit words.  A block has its final states, the place where its words begin (a checkpoint
from which it decodes alone) and the CRC-32 of its ids, so blocks decode in parallel and damage is noticed.
Spark's own writer commits the files: a lost executor leaves no half-written segment.
"""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import new_path
from ._text import byte_hashes, columns

MAGIC = b"rans1"
LANES, BLOCK, SCALE_BITS = 32, 1 << 15, 18
#: A segment is closed by the document with which it has so many ids or more.  A segment is a row, of some 2 MB: larger ones
#: are held several times over by the JVM and its writers.
SEGMENT = 1 << 20
#: Bytes of texts that are tokenized at a time, in whole texts.
AT_ONCE = 1 << 21
END_ID = 2
U = np.uint64
_LOW = U(1 << 31)

#: White space other than blanks and line feeds, and separators on whose class libraries differ.
_OTHER_SPACE = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"


# --- coding ------------------------------------------------------------------------------------------------


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts (all positive) scaled to a sum of 2**SCALE_BITS, none to zero."""
    total = 1 << SCALE_BITS
    f = np.maximum(1, counts * total // counts.sum())
    order = np.argsort(-f, kind="stable")
    over = int(f.sum()) - total
    for i in order:
        if over == 0:
            break
        step = min(over, int(f[i]) - 1) if over > 0 else over
        f[i] -= step
        over -= step
    return f


def encode(ids: np.ndarray) -> dict:
    """A segment of ids: symbols, freqs, states, offsets, words, crcs, as bytes; n_ids."""
    n = len(ids)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    f = frequencies(counts[symbols]).astype(np.uint64)
    code = (np.cumsum(counts > 0) - 1)[ids]
    c = np.cumsum(f) - f
    blocks = -(-n // BLOCK)
    block = min(BLOCK, -(-n // LANES) * LANES)
    steps = block // LANES
    padded = np.zeros(blocks * block, np.int64)
    padded[:n] = code
    grid = padded.reshape(blocks, steps, LANES).transpose(1, 0, 2).reshape(steps, blocks * LANES)
    x = np.full(blocks * LANES, _LOW)
    words, lanes = [], []
    for t in range(steps - 1, -1, -1):
        fs, cs = f[grid[t]], c[grid[t]]
        full = np.flatnonzero(x >= fs << U(63 - SCALE_BITS))[::-1]
        words.append(x[full] & U(0xFFFFFFFF))
        lanes.append(full)
        x[full] >>= U(32)
        q = x // fs
        x = (q << U(SCALE_BITS)) + (x - q * fs) + cs
    word = np.concatenate(words)[::-1].astype(np.uint32)
    of = np.concatenate(lanes)[::-1] // LANES
    word = word[np.argsort(of, kind="stable")]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=blocks))]).astype(np.uint32)
    little = ids.astype("<u4")
    crcs = np.array([zlib.crc32(little[b * block : (b + 1) * block].tobytes()) for b in range(blocks)], np.uint32)
    return {"n_ids": n, "symbols": symbols.astype("<u4").tobytes(), "freqs": f.astype("<u4").tobytes(), "states": x.astype("<u8").tobytes(), "offsets": offsets.astype("<u4").tobytes(), "words": word.astype("<u4").tobytes(), "crcs": crcs.astype("<u4").tobytes()}


def decode(segment: dict, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (exclusive; None: all) of a segment; raises ValueError on damage."""
    n = segment["n_ids"]
    symbols, f = np.frombuffer(segment["symbols"], "<u4"), np.frombuffer(segment["freqs"], "<u4").astype(np.uint64)
    offsets, crcs = np.frombuffer(segment["offsets"], "<u4").astype(np.int64), np.frombuffer(segment["crcs"], "<u4")
    words = np.frombuffer(segment["words"], "<u4").astype(np.uint64)
    last = len(crcs) if last is None else last
    block = min(BLOCK, -(-n // LANES) * LANES)
    blocks, steps = last - first, block // LANES
    c = np.cumsum(f) - f
    slots = np.repeat(np.arange(len(f), dtype=np.int32), f.astype(np.int64))
    x = np.frombuffer(segment["states"], "<u8").astype(np.uint64).reshape(-1, LANES)[first:last].copy()
    at = offsets[first:last].copy()
    out = np.empty((steps, blocks, LANES), np.int32)
    for t in range(steps):
        slot = x & U((1 << SCALE_BITS) - 1)
        s = slots[slot]
        out[t] = s
        x = f[s] * (x >> U(SCALE_BITS)) + slot - c[s]
        need = x < _LOW
        rank = np.cumsum(need, axis=1)
        take = (at[:, None] + rank - 1)[need]
        x[need] = (x[need] << U(32)) | words[take]
        at += rank[:, -1]
    ids = symbols[out.transpose(1, 0, 2).reshape(-1)][: min(n, last * block) - first * block]
    for b in range(blocks):
        if zlib.crc32(ids[b * block : (b + 1) * block].astype("<u4").tobytes()) != crcs[first + b]:
            raise ValueError(f"block {first + b} is damaged")
    return ids


# --- tokenizing --------------------------------------------------------------------------------------------


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def _added(path: str) -> list[str]:
    """Contents of the tokens that the tokenizer finds in a text before it splits it."""
    return [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]


@lru_cache(2)
def _token_bytes(path: str) -> np.ndarray:
    """How many bytes each id stands for: in the byte-level alphabet a character is a byte."""
    vocabulary = _tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        out[i] = len(token)
    return out


def _raw(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large binaries, and where each begins in them."""
    offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    data = np.frombuffer(pieces.buffers()[2], np.uint8) if offsets[-1] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class _Pieces:
    """Ids of pieces met so far: piece k has ids[starts[k]:starts[k] + sizes[k]], and was asked for hits[k] times.

    A piece is looked up by its 64-bit hash in an open-addressing table of numbers, and compared as it is.
    """

    #: Pieces, and bytes of pieces, from which on half of them are forgotten, those asked for least.
    MOST, MOST_BYTES, SLOT_BITS = 1 << 20, 1 << 25, 22
    #: A longer piece is never remembered.
    LONGEST = 1 << 10

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.table = np.full(1 << self.SLOT_BITS, -1, np.int32)
        self.names, self.hashes, self.ids = pa.array([], pa.large_binary()), np.empty(0, U), np.empty(0, np.uint32)
        self.starts, self.sizes, self.hits = (np.empty(0, np.int64) for _ in range(3))

    def coded(self, pieces: pa.Array, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different pieces behind each other, and how many each has; texts have them so many ``times``."""
        parts = []
        for low in range(0, max(1, len(pieces)), self.MOST):  # so that the table never fills up
            place = self._lookup(pieces.slice(low, self.MOST), times[low : low + self.MOST])
            sizes = self.sizes[place]
            parts.append((self.ids[np.repeat(self.starts[place] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes))
        ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        return ids, sizes

    def _lookup(self, pieces: pa.Array, times: np.ndarray) -> np.ndarray:
        """The numbers of different pieces."""
        if len(self.starts) > self.MOST or self.names.nbytes > self.MOST_BYTES:
            self._forget()
        data, at = _raw(pieces)
        h = byte_hashes(data, at[:-1], at[1:])
        out = self._find(h)
        met = np.flatnonzero(out >= 0)
        other = met[~pc.equal(pieces.take(pa.array(met)), self.names.take(pa.array(out[met]))).to_numpy(zero_copy_only=False)]
        out[other] = -1  # another piece of equal hash: encoded again each time
        new = np.flatnonzero(out < 0)
        if len(new):
            # between pieces that start with white space and end without, a text can be cut: encode many at once
            blank = np.append((data == 0x20) | (data == 0x0A), False)
            cuttable = blank[at[new]] & ~blank[at[new + 1] - 1]
            new = np.concatenate([new[~cuttable], new[cuttable]])
            names, odd = pieces.take(pa.array(new)), int((~cuttable).sum())
            raw = names.to_pylist()
            parts = [self._apart(raw[:odd]), *(self._together(raw[low : low + 4096]) for low in range(odd, len(raw), 4096))]
            out[new] = np.arange(len(self.starts), len(self.starts) + len(new))
            self._add(names, h[new], *(np.concatenate(x) for x in zip(*parts, strict=True)))
            if len(new) > len(other):
                fresh = out[np.setdiff1d(new, other)]
                self._insert(fresh)
        self.hits[out] += times
        return out

    def _find(self, h: np.ndarray) -> np.ndarray:
        out, going, mask = np.full(len(h), -1), np.arange(len(h)), U(len(self.table) - 1)
        slot = h & mask
        while len(going):
            k = self.table[slot]
            hit = (k >= 0) & (self.hashes[k] == h[going]) if len(self.hashes) else np.zeros(len(k), bool)
            out[going[hit]] = k[hit]
            on = (k >= 0) & ~hit
            going, slot = going[on], (slot[on] + U(1)) & mask
        return out

    def _insert(self, numbers: np.ndarray) -> None:
        mask = U(len(self.table) - 1)
        slot = self.hashes[numbers] & mask
        while len(numbers):
            free = self.table[slot] < 0
            self.table[slot[free]] = numbers[free]
            lost = self.table[slot] != numbers
            numbers, slot = numbers[lost], (slot[lost] + U(1)) & mask

    def _apart(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in _tokenizer(self.path).encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        return np.array([i for own in ids for i in own], np.uint32), np.array([len(own) for own in ids], np.int64)

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(_tokenizer(self.path).encode_batch_fast([b"".join(pieces).decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(list(map(len, pieces)))
        upto = np.cumsum(_token_bytes(self.path)[ids])
        cuts = np.searchsorted(upto, ends)
        if len(upto) and upto[-1] == ends[-1] and (upto[cuts] == ends).all():
            return ids, np.diff(cuts, prepend=-1)
        return self._apart(pieces)

    def _add(self, names: pa.Array, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes, self.hits = np.concatenate([self.sizes, sizes]), np.concatenate([self.hits, np.zeros(len(sizes), np.int64)])
        self.ids, self.hashes = np.concatenate([self.ids, ids]), np.concatenate([self.hashes, hashes])
        self.names = pa.concat_arrays([self.names, names])

    def _forget(self) -> None:
        size = np.diff(_raw(self.names)[1])
        order = np.argsort(-self.hits, kind="stable")
        order = order[size[order] <= self.LONGEST][: self.MOST // 2]
        order = order[np.cumsum(size[order]) <= self.MOST_BYTES // 4]
        _, first = np.unique(self.hashes[order], return_index=True)
        keep = order[first]
        sizes = self.sizes[keep]
        ids = self.ids[np.repeat(self.starts[keep] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        names, hashes = self.names.take(pa.array(keep)), self.hashes[keep]
        self.clear()
        self._add(names, hashes, ids, sizes)
        self._insert(np.arange(len(keep)))


_known: dict[str, _Pieces] = {}


def _whole(path: str, texts: pa.Array) -> np.ndarray:
    """Which texts can't be cut before blanks and line feeds: those with other white space or with an added token."""
    out = pc.match_substring_regex(texts, _OTHER_SPACE)
    for token in _added(path):
        out = pc.or_(out, pc.match_substring(texts, token))
    return out.to_numpy(zero_copy_only=False)


def tokenize(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts (no nulls) behind each other, and where each text's begin, as ``encode(text, add_special_tokens=False)`` gives them.

    The byte-level pre-tokenizer never joins what stands before white space with what follows: pieces that
    start with a run of blanks or line feeds have ids of their own, and repeated pieces are encoded once.
    """
    whole = _whole(path, texts)
    data, bounds = columns(texts.filter(pa.array(~whole)))
    space = (data == 0x20) | (data == 0x0A)
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[bounds[:-1][np.diff(bounds) > 0]] = True
    at = np.flatnonzero(cut)
    offsets = np.append(at, len(data)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
    known, index = _known.setdefault(path, _Pieces(path)), pieces.indices.to_numpy()
    every, size = known.coded(pieces.dictionary, np.bincount(index, minlength=len(pieces.dictionary)))
    sizes, starts = size[index], (np.cumsum(size) - size)[index]
    total = np.append(0, np.cumsum(sizes))
    ids = every[np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])]
    ends = total[np.searchsorted(at, bounds)]
    if not whole.any():
        return ids, ends
    parts, own = [], iter(np.split(ids, ends[1:-1]) if len(ends) > 1 else [])
    rest = iter(_tokenizer(path).encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False))
    for alone in whole.tolist():
        parts.append(np.array(next(rest).ids, np.uint32) if alone else next(own))
    return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))


def runs(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Where runs of texts of ``most`` bytes (None: AT_ONCE) in all begin and end; a longer text is a run of its own."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    low, most = 0, AT_ONCE if most is None else most
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, most + (ends[low - 1] if low else 0), "right")))
        yield low, high
        low = high


def _release(known: bool = False) -> None:
    """Gives memory back that Arrow and the C library hold freed; with ``known``, the pieces met so far too."""
    if known:
        _known.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# --- store -------------------------------------------------------------------------------------------------

_SEGMENT = "part int, seq int, begins long, n_ids long, doc_ids array<{id}>, lengths array<long>, magic binary, symbols binary, freqs binary, states binary, offsets binary, words binary, crcs binary"


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Writes the ids of all texts, each with end_id behind it, in ascending order of id_column (nulls first)."""
    spark = docs.sparkSession
    id_type = docs.schema[id_column].dataType
    df = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), F.xxhash64(text_column).alias("tie"))
    df = df.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id", "tie").sortWithinPartitions("id", "tie").drop("tie")
    schema = _SEGMENT.format(id=id_type.simpleString())

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, begins = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        names: list = []
        end = np.array([end_id], np.uint32)

        def closed() -> pa.RecordBatch:
            lengths = [len(x) for x in ids]
            row = {"part": part, "seq": seq, "begins": begins, "doc_ids": names, "lengths": lengths, "magic": MAGIC} | encode(np.concatenate(ids))
            fields = ["part", "seq", "begins", "n_ids", "doc_ids", "lengths", "magic", "symbols", "freqs", "states", "offsets", "words", "crcs"]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), *[pa.binary()] * 7]
            return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in zip(fields, kinds, strict=True)], fields)

        held = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for low, high in runs(batch.column(1)):
                some = batch.slice(low, high - low)
                every, at = tokenize(tokenizer_path, some.column(1))
                for name, own in zip(some.column(0).to_pylist(), np.split(every, at[1:-1]), strict=True):
                    ids.append(np.concatenate([own, end]))
                    names.append(name)
                    held += len(own) + 1
                    if held >= SEGMENT:
                        yield closed()
                        begins, seq, ids, names, held = begins + held, seq + 1, [], [], 0
                        _release()
        if ids:
            yield closed()

    df.mapInArrow(segments, schema).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its little-endian 32-bit ids)."""
    df = spark.read.parquet(path)
    id_type = df.schema["doc_ids"].dataType.elementType
    totals = {r.part: r.n for r in df.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, at = {}, 0
    for part in sorted(totals):
        before[part] = at
        at += totals[part]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release(known=True)  # this worker may have written the store
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names if k != "doc_ids"}
                if row["magic"] != MAGIC:
                    raise ValueError("not a segment of this format")
                raw = decode(row).astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(ends - lengths, ends, strict=True)]
                start = before[row["part"]] + row["begins"] + ends - lengths
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, pa.array(start), pa.array(lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return df.mapInArrow(documents, f"doc_id {id_type.simpleString()}, start long, n_tokens long, ids_crc32 long")


def token_report(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Writes a store of docs (to a new place in the shared folder unless path is given) and reads it back.

    A null or empty text has the end id only.  Rows with equal ids stay rows of their own, next to each other;
    null ids come first.  Other columns are ignored.  An empty table gives an empty result.
    """
    path = path or new_path(docs.sparkSession)
    write_store(docs, path, tokenizer_path)
    return read_store(docs.sparkSession, path)

"""N-gram Jaccard join: which documents have nearly the same word shingles.

The document by n-gram incidence is multiplied with its transpose in blocks of n-grams (_setjoin), overlap
counts below the bounds that two sizes set are discarded early, the rest is counted exactly, and links are
closed into components.  Documents with equal shingle sets are one row of the matrix.

A pair inside one long list of a frequent n-gram is only counted where its two sets are not connected
already: links within a group that is connected anyway change no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _setjoin
from ._scratch import written
from ._text import binary16, keys, shingle_sets

NUM, DEN = 4, 5
#: Tasks that a long list's members are dealt to.
SALTS = 32


def _sets_of(words: int, column: int = 0) -> _setjoin.Sets:
    def sets(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        held: list[np.ndarray] = []
        for _, s in shingle_sets(batch.column(column), words):
            held.append(s)
            if len(held) == 1024:
                yield held
                held = []
        if held:
            yield held

    return sets


def ngram_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row for each row of docs: id_column, n_shingles and component_id, the least id of its component.

    Two texts link when their sets of ``words``-word shingles (A-Z lower-cased) have a Jaccard similarity of
    num / den or more.  A null, empty or blank text has no shingles (n_shingles 0), links with nothing and is
    a component of its own.  Texts under ``words`` words have one shingle, their whole sequence.  Equal sets
    always link, so repeated rows share a component.  A null id is never a component's least id unless all
    its ids are null.  Other columns of docs are ignored.  The result's order is not defined.
    """
    df = docs.select(F.col(text_column).alias("text"))
    sets = _sets_of(words)
    id_type = docs.schema[id_column].dataType

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [s for _, s in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in every], pa.int64()), binary16(k := keys(every)), pa.array(k[:, 0].view(np.int64)), pa.array([_setjoin.parity_bits(s) if len(s) else None for s in every], pa.binary()), pa.array([_setjoin.parity_bits(s, _setjoin.SMALL_BITS) if len(s) else None for s in every], pa.binary())], ["id", "n_shingles", "key", "node", "bits", "small"])

    marks = docs.select(F.col(id_column).alias("id"), F.col(text_column)).mapInArrow(fingerprint, f"id {id_type.simpleString()}, n_shingles long, key binary, node long, bits binary, small binary")
    marks = written(marks)
    labels = _labels(df, marks, sets, num, den)
    least = marks.where("n_shingles > 0").groupBy("key").agg(F.min("id").alias("least"))
    named = least.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = named.join(named.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("key", "component_id")
    out = marks.join(named, "key", "left")
    return out.select(F.col("id").alias(id_column), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _labels(df: DataFrame, marks: DataFrame, sets: _setjoin.Sets, num: int, den: int) -> DataFrame:
    levels = _setjoin.order_levels(df, sets)
    found = written(_setjoin.candidates(df, sets, num, den, levels))
    pairs = written(found.where("kind = 0").select("x", "y").distinct())
    bits = marks.where("n_shingles > 0").groupBy("node").agg(F.max("n_shingles").alias("n"), F.max("bits").alias("bits"), F.max("small").alias("small"))
    links = _setjoin.verified(df, sets, _setjoin.possible(pairs, bits, num, den), num, den)
    labels = written(_setjoin.components(links))
    # what long lists have left: pairs of sets in different components
    node = F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("long")
    wide = found.where("kind = 1").select(F.col("x"), F.col("y").alias("list"), "n", "pos", "length")
    wide = wide.join(labels.select(node.alias("x"), F.hex("label").alias("label")), "x", "left").withColumn("label", F.coalesce("label", F.hex("x")))
    mixed = wide.groupBy("list").agg((F.min("label") < F.max("label")).alias("mixed")).where("mixed").select("list", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    wide = wide.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int"))  # a long list isn't one task's
    wide = written(wide.join(mixed, ["list", "salt"], "left_semi").drop("salt"))
    rest = _setjoin.possible(written(_setjoin.remaining(wide, bits, num, den).join(pairs, ["x", "y"], "left_anti")), bits, num, den)
    if rest.isEmpty():
        return labels
    more = _setjoin.verified(df, sets, rest, num, den)
    return written(_setjoin.components(links.union(more)))


def representatives(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component of docs, that with the least id; of equal rows one.  Rows without shingles all stay.

    Ids may be of any type with an order; a null id is the last.  An empty table gives an empty result.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))
    packed = docs.select(F.struct(*columns).alias("row"), key.alias("__key"))
    ids = docs.select(F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), key.alias("key")).alias("id"), F.col(text_column).alias("text"))
    found = ngram_components(ids, "id", "text")
    stay = written(found.where("n_shingles = 0 OR id = component_id").groupBy(F.col("id.key").alias("__key")).agg(F.max("n_shingles").alias("n"), F.count("*").alias("rows")))
    repeated = stay.where("n > 0 AND rows > 1").select("__key")
    out = packed.join(stay.where("n = 0 OR rows = 1").select("__key"), "__key", "left_semi")
    if not repeated.isEmpty():
        out = out.union(packed.join(repeated, "__key", "left_semi").dropDuplicates(["__key"]))
    return out.select("row.*")

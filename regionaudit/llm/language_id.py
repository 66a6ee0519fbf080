"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language's dictionary is raw content: pieces of a bounded, seeded sample of its labelled documents.  A
text is lower-cased and compressed piece by piece, so that the dictionary, not the text's own past, decides throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sample: so many documents a language, and of each at most so many characters from a drawn place on.
SAMPLE_DOCS, SAMPLE_CHARS = 256, 1024
PIECE_BYTES, LEVEL = 4096, 6
#: Below this margin a prediction is marked as rejected.
LEAST_MARGIN = 0.02
UNDETERMINED = "und"
#: Documents a language that are drawn by hash, on average, before the sample is taken from them in order.
DRAWN = 8 * SAMPLE_DOCS


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(id_column).cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def dictionaries(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> dict[str, bytes]:
    """Raw-content dictionaries by language, from a sample of the rows of docs that have a text and a language."""
    lang, text = F.col(lang_column), F.col(text_column)
    known = docs.where(lang.isNotNull() & text.rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in known.groupBy(lang.alias("lang")).count().collect()}
    if not counts:
        return {}
    # a share of each language, so that the window holds few rows however many a language has
    draw, one = F.xxhash64(F.lit(7), F.col(id_column), text), 1 << 40
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, one * min(n, DRAWN) // n)])
    at = 1 + F.pmod(draw, F.greatest(F.lit(1), F.length(text) - SAMPLE_CHARS))
    drawn = known.where(F.pmod(draw, F.lit(one)) < share[lang]).select(lang.alias("lang"), draw.alias("draw"), F.substring(text, at.cast("int"), F.lit(SAMPLE_CHARS)).alias("piece"))
    rows = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "piece"))).where(F.col("rank") <= SAMPLE_DOCS).collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.rank)):
        out.setdefault(r.lang, []).append(r.piece)
    return {lang: "\n".join(pieces).lower().encode() for lang, pieces in out.items()}


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        self.languages = sorted(content)
        self.compressors = []
        for lang in self.languages:
            data = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=data, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, margin (how much smaller than the runner-up, 0 to 1) and whether the margin is too narrow."""
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        raw = text.lower().encode()
        pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
        sizes = sorted((sum(len(c.compress(p)) for p in pieces), lang) for c, lang in zip(self.compressors, self.languages, strict=True))
        margin = 1.0 if len(sizes) == 1 else 1 - sizes[0][0] / max(sizes[1][0], 1)
        return sizes[0][1], margin, margin < LEAST_MARGIN


def languages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """One row for each document: id_column, held_out, lang_pred, score (the margin) and rejected.

    Learns from rows that are not held out and have a language; a null id is not held out and is not learned
    from.  Null texts and texts without a letter get ``und`` with score 0, as does everything if there is
    nothing to learn from; an empty table gives an empty result.  With one language learned the score is 1.  Ties go to the first language by name;
    repeated rows are judged alike; other columns are ignored.
    """
    content = dictionaries(docs.where(~held_out(id_column) & F.col(id_column).isNotNull()), id_column, text_column, lang_column)
    shared = docs.sparkSession.sparkContext.broadcast(content)
    id_type = docs.schema[id_column].dataType

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch in batches:
            said = [classifier.predict(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64()), pa.array([x[2] for x in said], pa.bool_())], ["id", "held_out", "lang_pred", "score", "rejected"])

    slim = docs.select(F.col(id_column).alias("id"), held_out(id_column).alias("held_out"), F.col(text_column).alias("text"))
    return slim.mapInArrow(judge, f"id {id_type.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_column)

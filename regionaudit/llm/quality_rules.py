"""Quality rules: a threshold table compiled into one projection, without user functions.

Every measure is an integer count and every rule compares counts multiplied by integers, so that verdicts do
not depend on rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "that", "is", "was", "for", "with",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "nicht",
    "le", "la", "les", "de", "et", "des", "en", "un", "une", "que",
    "el", "los", "las", "y", "por", "con", "para", "una", "se", "no",
)


@dataclass(frozen=True)
class Rule:
    """Fails where 100 * count < least * of, or 100 * count > most * of; only from ``words`` words on."""

    name: str
    count: str
    of: str
    least: int | None = None
    most: int | None = None
    words: int = 0


RULES = (
    Rule("word_length", "word_chars", "n_words", least=200, most=2000),
    Rule("symbols", "n_symbols", "n_words", most=50),
    Rule("stop_words", "n_stop_words", "n_words", least=1, words=50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=30),
    Rule("wordlike", "n_alphabetic", "n_words", least=60),
)
LEAST_WORDS, MOST_REPEATED = 20, 30


def n_words(text: Column) -> Column:
    """Number of words of a text without nulls, as a long."""
    return F.size(_words(text)).cast("long")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def measures(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs as a struct column ``row`` and its measures; a null text counts as an empty one."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"))
    # the marker keeps the split in a projection of its own, so it runs once
    df = df.select("row", "text", _words(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("lines"))
    hashes = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<long>"))
    df = df.select("row", "text", "words", "lines", hashes.alias("windows"))
    # windows in the order of their hashes; of equal neighbours both are repeats
    placed = F.array_sort(F.zip_with("windows", F.sequence(F.lit(1), F.size("windows")), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed))
    alike = F.filter(F.transform("placed", lambda x, k: F.when((x["h"] == F.get("placed", k - 1)["h"]) | (x["h"] == F.get("placed", k + 1)["h"]), x["i"])), lambda i: i.isNotNull())
    df = df.withColumn("repeats", F.sort_array(alike))
    covered = F.aggregate(F.transform("repeats", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("repeats", k + 1) - x, F.lit(WINDOW))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    n = lambda c: c.cast("long")
    return df.select(
        "row",
        n(F.size("words")).alias("n_words"),
        n(F.length(F.translate("text", SPACES, ""))).alias("word_chars"),
        n(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        n(F.size("lines")).alias("n_lines"),
        n(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        n(F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS)))).alias("n_stop_words"),
        n(F.size(F.filter("words", lambda w: w.rlike(r"\p{L}")))).alias("n_alphabetic"),
    )


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the failed rules of the table, compiled into one expression over the measures."""
    tests = []
    for r in rules:
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (100 * F.col(r.count) < r.least * F.col(r.of))
        if r.most is not None:
            bad = bad | (100 * F.col(r.count) > r.most * F.col(r.of))
        tests.append(F.when(bad & (F.col("n_words") >= r.words), F.lit(r.name)))
    return F.array_compact(F.array(*tests))


def judged(docs: DataFrame, text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs as a struct column ``row``, with the measures, base_failed, failed (names of rules) and kept.

    A null text counts as an empty one: it has no words and fails.  Repeated rows are judged alike.  Columns of
    docs stay inside ``row``, whatever their names.
    """
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = measures(docs, text_column).withColumn("base_failed", base).withColumn("failed", failed_rules(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def quality_verdicts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: id_column, measures, base_failed, kept (see judged)."""
    return judged(docs, text_column).select(
        F.col(f"row.{id_column}").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def kept_documents(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of docs that the rules keep (see judged): none of a null or empty text, repeats alike, of an empty table none."""
    # a non-deterministic term keeps the filter above the measures: pushed down, it would copy them into itself again and again
    stays = F.col("kept") & (F.monotonically_increasing_id() >= 0)
    return judged(docs, text_column).select("row", stays.alias("stays")).where("stays").select("row.*")

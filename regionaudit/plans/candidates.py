"""Discovered candidates of two runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators.human import count_if
from ..sources.fixtures import DISCOVERIES, discoveries, table
from .registry import query


def _bucket(raw: str) -> str:
    said = rf"regexp_replace(lower(regexp_replace({raw}, '^\s+|\s+$', '', 'g')), '\.+$', '')"
    return rf"""CASE WHEN {raw} IS NULL OR NOT regexp_matches({raw}, '[\p{{L}}\p{{N}}]') THEN 'no-response' WHEN (dense_class = 1 AND {said} = 'vehicle') OR (dense_class = 2 AND {said} = 'sign') OR (dense_class = 3 AND {said} IN ('cyclist', 'pedestrian')) THEN 'confirmed'
 WHEN {said} = 'other' THEN 'other' ELSE 'unanswered' END"""


_B = f"WITH {DISCOVERIES}, b AS (SELECT *, {_bucket('raw_a')} AS a, {_bucket('raw_b')} AS b FROM discoveries)"


def _bucketed(spark, sf_dir):
    df = discoveries(spark, sf_dir)
    return df.withColumn("a", R.discovery_bucket(F.col("raw_a"), F.col("dense_class"))).withColumn("b", R.discovery_bucket(F.col("raw_b"), F.col("dense_class")))


@query(f"{_B} SELECT dense_class, a AS bucket, count(*) AS n, sum(px)::BIGINT AS px FROM b GROUP BY ALL")
def discovery_buckets(spark, sf_dir):
    return _bucketed(spark, sf_dir).groupBy("dense_class", F.col("a").alias("bucket")).agg(F.count("*").alias("n"), F.sum("px").alias("px"))


@query(f"{_B}, l AS (SELECT frame, ordinal, x1, a FROM b), r AS (SELECT frame, ordinal, x1 + (px % 50 = 0)::INT AS x1, b FROM b) SELECT a, b, l.x1 <> r.x1 AS misaligned, count(*) AS n FROM l JOIN r USING (frame, ordinal) GROUP BY ALL")
def discovery_transitions(spark, sf_dir):
    """Candidates of the runs paired by place in their frame; pairs with different boxes are counted apart."""
    df = _bucketed(spark, sf_dir)
    left = df.select("frame", "ordinal", F.col("box.x1").alias("xa"), "a")
    right = df.select("frame", "ordinal", (F.col("box.x1") + (F.col("px") % 50 == 0).cast("int")).alias("xb"), "b")
    return left.join(right, ["frame", "ordinal"]).groupBy("a", "b", (F.col("xa") != F.col("xb")).alias("misaligned")).agg(F.count("*").alias("n"))


_C = f"""{_B}, r AS (SELECT frame, x1, y1, x2, y2, arg_max(b, ordinal) AS b, arg_max(dense_class, ordinal) AS cb FROM b GROUP BY ALL),
 m AS (SELECT l.*, r.b AS rb, r.cb, l.a = 'confirmed' AS ca, coalesce(r.b = 'confirmed', false) AS cbn FROM b l LEFT JOIN r USING (frame, x1, y1, x2, y2))"""


def _merged(spark, sf_dir):
    """Run a's candidates with run b's on the same box; of several, b's last."""
    df = _bucketed(spark, sf_dir)
    right = df.groupBy("frame", "box").agg(F.max_by("b", "ordinal").alias("rb"), F.max_by("dense_class", "ordinal").alias("cb"))
    return df.join(right, ["frame", "box"], "left").withColumn("ca", F.col("a") == "confirmed").withColumn("cbn", F.coalesce(F.col("rb") == "confirmed", F.lit(False)))


@query(f"{_C} SELECT dense_class, ca AND cbn AND dense_class = cb AS confirmed, ca AND cbn AND dense_class <> cb AS class_differs, count(*) AS n FROM m GROUP BY ALL")
def discovery_consensus_both(spark, sf_dir):
    both, same = F.col("ca") & F.col("cbn"), F.col("dense_class") == F.col("cb")
    return _merged(spark, sf_dir).groupBy("dense_class", (both & same).alias("confirmed"), (both & ~same).alias("class_differs")).agg(F.count("*").alias("n"))


@query(f"{_C} SELECT CASE WHEN NOT ca AND cbn THEN cb ELSE dense_class END AS class_id, ca OR cbn AS confirmed, count(*) AS n FROM m GROUP BY ALL")
def discovery_consensus_either(spark, sf_dir):
    return _merged(spark, sf_dir).groupBy(F.when(~F.col("ca") & F.col("cbn"), F.col("cb")).otherwise(F.col("dense_class")).alias("class_id"), (F.col("ca") | F.col("cbn")).alias("confirmed")).agg(F.count("*").alias("n"))


_STRATUM = "CASE WHEN a = 'confirmed' AND b = 'confirmed' THEN 'both' WHEN a = 'confirmed' THEN 'a_only' WHEN b = 'confirmed' THEN 'b_only' ELSE 'neither' END"


def _stratum():
    a, b = F.col("a") == "confirmed", F.col("b") == "confirmed"
    return F.when(a & b, "both").when(a, "a_only").when(b, "b_only").otherwise("neither")


@query(f"{_B} SELECT {_STRATUM} AS stratum, count(*) AS n, count(*) FILTER (px % 3 <> 0) AS hits, count(*) FILTER (px % 3 <> 0) / count(*) AS \"precision\" FROM b GROUP BY ALL")
def strata_precision(spark, sf_dir):
    out = _bucketed(spark, sf_dir).groupBy(_stratum().alias("stratum")).agg(F.count("*").alias("n"), count_if(F.col("px") % 3 != 0).alias("hits"))
    return out.withColumn("precision", F.col("hits") / F.col("n"))


@query(f"{_B}, s AS (SELECT {_STRATUM} AS stratum, count(*) AS population, count(*) FILTER (px % 10 = 0) AS n, count(*) FILTER (px % 10 = 0 AND px % 3 <> 0) AS hits FROM b GROUP BY ALL) SELECT run, sum(population)::BIGINT AS population, round(sum(population * hits / n) / sum(population) * 1e6)::BIGINT AS precision_e6 FROM s, (SELECT unnest(['a', 'b']) AS run) WHERE stratum IN ('both', run || '_only') GROUP BY run")
def composed_precision(spark, sf_dir):
    """Precision of each run's confirmed set: sampled strata weighted by their population."""
    sampled = F.col("px") % 10 == 0
    s = _bucketed(spark, sf_dir).groupBy(_stratum().alias("stratum")).agg(F.count("*").alias("population"), count_if(sampled).alias("n"), count_if(sampled & (F.col("px") % 3 != 0)).alias("hits"))
    s = s.withColumn("run", F.explode(F.when(F.col("stratum") == "both", F.array(F.lit("a"), F.lit("b"))).when(F.col("stratum") == "a_only", F.array(F.lit("a"))).when(F.col("stratum") == "b_only", F.array(F.lit("b")))))
    weighted = F.sum(F.col("population") * F.col("hits") / F.col("n")) / F.sum("population")
    return s.groupBy("run").agg(F.sum("population").alias("population"), F.round(weighted * 1e6).cast("long").alias("precision_e6"))


@query(f"{_B} SELECT dense_class, count(*) FILTER (a = 'confirmed') AS confirmed, count(*) FILTER (a = 'confirmed' AND px % 3 <> 0) / nullif(count(*) FILTER (a = 'confirmed'), 0) - count(*) FILTER (px % 3 <> 0) / count(*) AS lift FROM b GROUP BY ALL")
def confirmation_lift(spark, sf_dir):
    real, yes = F.col("px") % 3 != 0, F.col("a") == "confirmed"
    return _bucketed(spark, sf_dir).groupBy("dense_class").agg(count_if(yes).alias("confirmed"), (F.try_divide(count_if(yes & real), count_if(yes)) - count_if(real) / F.count("*")).alias("lift"))


@query(f"""{_B}, t AS (SELECT frame, ordinal, unnest([ordinal - 1, ordinal + 2, 9999]) AS other FROM b), n AS (SELECT t.frame, t.ordinal, o.dense_class AS oc FROM t LEFT JOIN b o ON o.frame = t.frame AND o.ordinal = t.other),
 k AS (SELECT b.frame, b.ordinal, b.px % 3 <> 0 AS real, coalesce(bool_or(oc = dense_class), false) AS same FROM b JOIN n USING (frame, ordinal) GROUP BY ALL)
 SELECT CASE WHEN same AND NOT real THEN 'edge_bleed' WHEN same THEN 'boundary_growth' WHEN NOT real THEN 'false_alarm' ELSE 'new_object' END AS geometry, count(*) AS n FROM k GROUP BY ALL""")
def geometry_taxonomy(spark, sf_dir):
    """Candidates by what they touch and what the human said; ids of touching regions that don't resolve are ignored."""
    df = _bucketed(spark, sf_dir)
    ids = F.to_json(F.array(F.col("ordinal") - 1, F.col("ordinal") + 2, F.lit(9999)))
    touching = df.select("frame", "ordinal", "dense_class", "px", F.explode(F.from_json(ids, "array<int>")).alias("other"))
    known = df.select("frame", F.col("ordinal").alias("other"), F.col("dense_class").alias("other_class"))
    by = touching.join(known, ["frame", "other"], "left").groupBy("frame", "ordinal").agg(F.coalesce(F.bool_or(F.col("other_class") == F.col("dense_class")), F.lit(False)).alias("same"), F.any_value("px").alias("px"))
    real, same = F.col("px") % 3 != 0, F.col("same")
    return by.groupBy(F.when(same & ~real, "edge_bleed").when(same, "boundary_growth").when(~real, "false_alarm").otherwise("new_object").alias("geometry")).agg(F.count("*").alias("n"))


@query(f"{_B}, r AS (SELECT frame, ordinal, px, row_number() OVER (PARTITION BY frame ORDER BY px DESC, dense_class, ordinal) AS r FROM b) SELECT count(*) AS n, sum(px)::BIGINT AS px, count(DISTINCT frame) AS frames FROM r WHERE r <= 20")
def candidate_cap(spark, sf_dir):
    from pyspark.sql import Window

    top = _bucketed(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("frame").orderBy(F.col("px").desc(), "dense_class", "ordinal"))).where("r <= 20")
    return top.agg(F.count("*").alias("n"), F.sum("px").alias("px"), F.count_distinct("frame").alias("frames"))


_NAMES = [*R.CLASSES, *R.STRONG_DISTRACTORS, *R.WEAK_DISTRACTORS]
_HAS = lambda t: rf"regexp_matches(lower(raw), '\b{t}s?\b')"


@query(rf"""WITH r AS (SELECT conv_id, turn, text AS raw FROM conversations UNION ALL SELECT event_id, 0, CASE event_type WHEN 'error' THEN '????' WHEN 'view' THEN 'A Sign.' WHEN 'click' THEN 'vehicles, road' WHEN 'purchase' THEN 'traffic_light' ELSE 'unclear' END FROM events),
 e AS (SELECT raw, c FROM r, (SELECT unnest(['vehicle', 'sign', 'cyclist', 'pedestrian']) AS c))
 SELECT c AS expected, CASE WHEN raw IS NULL OR NOT ({' OR '.join(map(_HAS, _NAMES))}) OR {_HAS('unclear')} THEN NULL WHEN regexp_matches(lower(raw), '\b' || c || 's?\b') OR (c = 'sign' AND {_HAS('traffic_light')}) THEN 'valid'
 WHEN {' OR '.join(map(_HAS, R.STRONG_DISTRACTORS))} THEN 'background' ELSE 'invalid' END AS verdict, count(*) AS n FROM e GROUP BY ALL""")
def label_parse(spark, sf_dir):
    kind = F.col("event_type")
    said = F.when(kind == "error", "????").when(kind == "view", "A Sign.").when(kind == "click", "vehicles, road").when(kind == "purchase", "traffic_light").otherwise("unclear")
    raw = table(spark, sf_dir, "conversations").select(F.col("text").alias("raw")).union(table(spark, sf_dir, "events").select(said))
    raw = raw.withColumn("expected", F.explode(F.array(*[F.lit(c) for c in R.CLASSES])))
    return raw.groupBy("expected", R.parse_label(F.col("raw"), F.col("expected")).alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT v AS reply, count(*) AS n FROM (SELECT ['vehicle', 'sign', 'other', '??????????'][('0x' || substr(md5(left(text, 256) || source), 1, 4))::INT % 4 + 1] AS v FROM documents) GROUP BY ALL")
def mock_replies(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return df.groupBy(R.mock_reply(F.col("text"), F.col("source"), ("vehicle", "sign", "other", "??????????")).alias("reply")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_name IS NULL THEN NULL ELSE 'labeler' END AS name, c_mktsegment FROM customer")
def anonymise(spark, sf_dir):
    from ..sources.sinks import anonymised

    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name")).alias("name"), "c_mktsegment")
    return anonymised(df, {"name": "labeler"})

"""Verdicts, runs and candidates brought together: coverage of joins, runs by place and by box, resolved classes, the judge cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import human as H
from ..operators import integrity as I
from ..operators.human import confusion, count_if, rates
from ..sources.fixtures import DISCOVERIES, REGIONS, decide_sql, discoveries, regions
from .candidates import _B, _bucketed
from .registry import query
from .scoring import _LONG, _ORDER, _long, _order
from .triage import _CELLS, _RATES

# --- verdicts and the state of a run ------------------------------------------------------------------------

_STATE = "state AS (SELECT frame_id, mask_id, stored_a FROM regions WHERE alpha_bp % 13 <> 0)"


def _state(df: DataFrame) -> DataFrame:
    """The state that a run left on disk: some masks have none."""
    return df.where("alpha_bp % 13 <> 0").select("frame_id", "mask_id", F.col("stored_a").alias("state"))


@query(f"WITH {REGIONS}, {_STATE} SELECT class_name, count(*) AS judged, count(s.mask_id) AS joined, 100 * count(s.mask_id) / count(*) AS percent FROM regions r LEFT JOIN state s USING (frame_id, mask_id) WHERE human IS NOT NULL GROUP BY class_name")
def state_coverage(spark, sf_dir):
    """How many judged masks have a state in the run."""
    df = regions(spark, sf_dir)
    both = df.where("human IS NOT NULL").select("frame_id", "mask_id", "class_name").join(_state(df), ["frame_id", "mask_id"], "left")
    return both.groupBy("class_name").agg(F.count("*").alias("judged"), F.count("state").alias("joined")).withColumn("percent", 100 * F.col("joined") / F.col("judged"))


@query(f"WITH {REGIONS}, {_STATE}, c AS (SELECT class_name, {_CELLS} FROM (SELECT class_name, s.stored_a <> 'reject' AS keep, human = 'correct' AS ok FROM regions JOIN state s USING (frame_id, mask_id) WHERE human IS NOT NULL) GROUP BY class_name) SELECT *, {_RATES} FROM c")
def state_scores(spark, sf_dir):
    df = regions(spark, sf_dir)
    both = df.where("human IS NOT NULL").select("frame_id", "mask_id", "class_name", "human").join(_state(df), ["frame_id", "mask_id"])
    return rates(confusion(both, F.col("state") != "reject", F.col("human") == "correct", "class_name"))


_PARTITION = "CASE WHEN y > x THEN 'correct' WHEN x > y THEN 'incorrect' WHEN y + x > 0 THEN 'tied' ELSE 'pending' END"


@query(f"""{_LONG}, c AS (SELECT r.frame_id, r.mask_id, r.class_name, count(*) FILTER (verdict = 'correct') AS y, count(*) FILTER (verdict = 'incorrect') AS x FROM regions r LEFT JOIN last USING (frame_id, mask_id) GROUP BY ALL)
 SELECT class_name, {_PARTITION} AS part, count(*) AS masks, count(DISTINCT frame_id) AS frames FROM c GROUP BY ALL""")
def verdict_partition(spark, sf_dir):
    """Masks whose consensus is resolved, tied, or pending for want of a verdict."""
    folded = H.verdicts(_long(spark, sf_dir), ["frame_id", "mask_id"], "ord", "labeler", "verdict")
    df = regions(spark, sf_dir).select("frame_id", "mask_id", "class_name").join(folded, ["frame_id", "mask_id"], "left")
    said = H.consensus(F.col("labelers"))
    part = F.coalesce(said, F.when(F.size(F.coalesce("labelers", F.create_map().cast("map<string,string>"))) > 0, "tied").otherwise("pending"))
    return df.groupBy("class_name", part.alias("part")).agg(F.count("*").alias("masks"), F.count_distinct("frame_id").alias("frames"))


_TESTS = {"quality": "quality = 'good'", "consistency": "consistency = 'pass'", "bbox_a": "bbox_a = 'valid'", "bbox_b": "bbox_b = 'valid'", "retained_a": "stored_a <> 'reject'", "retained_b": "stored_b <> 'reject'"}
_SIGNALS = " UNION ALL ".join(f"SELECT '{n}' AS signal, coalesce({t}, false) AS keep, human = 'correct' AS ok FROM regions WHERE human IS NOT NULL" for n, t in _TESTS.items())


@query(f"WITH {REGIONS}, s AS ({_SIGNALS}), c AS (SELECT signal, {_CELLS} FROM s GROUP BY signal) SELECT *, {_RATES} FROM c")
def signal_scores(spark, sf_dir):
    """Each judge's verdict as a prediction that the mask is correct."""
    entries = F.array(*[F.struct(F.lit(n).alias("signal"), F.coalesce(F.expr(t), F.lit(False)).alias("keep")) for n, t in _TESTS.items()])
    df = regions(spark, sf_dir).where("human IS NOT NULL").select("human", F.inline(entries))
    return rates(confusion(df, F.col("keep"), F.col("human") == "correct", "signal"))


_DECIDER = "CASE WHEN bbox_a IS NULL AND quality IS NULL THEN 'prefilter' WHEN bbox_a IS NULL THEN 'dense_only' ELSE 'model' END"


@query(f"""WITH {REGIONS}, d AS (SELECT *, CASE WHEN bbox_a = 'background' THEN NULL ELSE bbox_a END AS bb FROM regions)
 SELECT {_DECIDER.replace('bbox_a', 'bb')} AS decider, stored_a = 'reject' AND quality IS NOT DISTINCT FROM 'good' AS incremental, CASE WHEN (human = 'incorrect') = (stored_a = 'reject') THEN 'true' ELSE 'false' END || CASE WHEN stored_a = 'reject' THEN '_delete' ELSE '_keep' END AS cell,
 count(*) AS n FROM d WHERE human IS NOT NULL GROUP BY ALL""")
def deciders(spark, sf_dir):
    """Which part of the cascade decided, deletions that only the model adds, and whether the human agrees."""
    c = F.col
    df = regions(spark, sf_dir).where("human IS NOT NULL").withColumn("bb", F.when(c("bbox_a") != "background", c("bbox_a")))
    deletes = c("stored_a") == "reject"
    cell = F.concat(F.when((c("human") == "incorrect") == deletes, "true").otherwise("false"), F.when(deletes, "_delete").otherwise("_keep"))
    return df.groupBy(R.decider("bb", "quality").alias("decider"), (deletes & R.is_("quality", "good")).alias("incremental"), cell.alias("cell")).agg(F.count("*").alias("n"))


@query(f"WITH {REGIONS} SELECT class_name, CASE WHEN stored_a <> 'reject' THEN 'a' ELSE 'b' END AS keeps, (human = 'correct') = (stored_a <> 'reject') AS a_agrees, count(*) AS n, sum(pixel_count)::BIGINT AS px FROM regions WHERE human IS NOT NULL AND (stored_a = 'reject') <> (stored_b = 'reject') GROUP BY ALL")
def flip_arbitration(spark, sf_dir):
    """Masks that one run keeps and the other deletes: which of them the human agrees with."""
    c = F.col
    kept = c("stored_a") != "reject"
    df = regions(spark, sf_dir).where("human IS NOT NULL").where((c("stored_a") == "reject") != (c("stored_b") == "reject"))
    return df.groupBy("class_name", F.when(kept, "a").otherwise("b").alias("keeps"), ((c("human") == "correct") == kept).alias("a_agrees")).agg(F.count("*").alias("n"), F.sum("pixel_count").alias("px"))


# --- several runs ------------------------------------------------------------------------------------------

RUNS = ("a", "b", "c")


def _runs(spark, sf_dir) -> DataFrame:
    """Three runs' masks by place in their frame; run c shifts a tenth of the ids and has other boxes for some."""
    df = regions(spark, sf_dir).select("frame_id", "mask_id", "class_name", "stored_a", "stored_b", "alpha_bp")
    rows = F.array(*[F.struct(F.lit(r).alias("run"), d.alias("state"), i.alias("id"), b.alias("box")) for r, d, i, b in (
        ("a", F.col("stored_a"), F.col("mask_id"), F.col("alpha_bp")), ("b", F.col("stored_b"), F.col("mask_id"), F.col("alpha_bp")),
        ("c", F.when(F.col("alpha_bp") % 2 == 0, F.col("stored_a")).otherwise(F.col("stored_b")), F.col("mask_id") + (F.col("alpha_bp") % 10 == 0).cast("int"), F.col("alpha_bp") + (F.col("alpha_bp") % 11 == 0).cast("int")),
    )])
    return df.select("frame_id", F.col("mask_id").alias("ordinal"), "class_name", F.inline(rows))


_RUNS = f"""WITH {REGIONS}, runs AS (SELECT frame_id, mask_id AS ordinal, class_name, 'a' AS run, stored_a AS state, mask_id AS id, alpha_bp AS box FROM regions UNION ALL SELECT frame_id, mask_id, class_name, 'b', stored_b, mask_id, alpha_bp FROM regions
 UNION ALL SELECT frame_id, mask_id, class_name, 'c', CASE WHEN alpha_bp % 2 = 0 THEN stored_a ELSE stored_b END, mask_id + (alpha_bp % 10 = 0)::INT, alpha_bp + (alpha_bp % 11 = 0)::INT FROM regions)"""


@query(f"{_RUNS}, p AS (SELECT frame_id, ordinal, max(class_name) AS class_name, string_agg(state, '/' ORDER BY run) AS states FROM runs GROUP BY ALL HAVING count(*) = 3) SELECT class_name, states, count(*) AS n FROM p GROUP BY ALL")
def runs_by_place(spark, sf_dir):
    """Masks of all runs paired by their place in the frame."""
    states = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "state"))), lambda s: s["state"]), "/")
    paired = _runs(spark, sf_dir).groupBy("frame_id", "ordinal").agg(F.max("class_name").alias("class_name"), states.alias("states"), F.count("*").alias("runs")).where(F.col("runs") == len(RUNS))
    return paired.groupBy("class_name", "states").agg(F.count("*").alias("n"))


@query(f"""{_RUNS}, f AS (SELECT l.frame_id, count(*) FILTER (l.id <> r.id OR l.box <> r.box) AS off FROM runs l JOIN runs r USING (frame_id, ordinal) WHERE l.run = 'a' AND r.run = 'c' GROUP BY l.frame_id)
 SELECT off > 0 AS refused, count(*) AS frames, sum(off)::BIGINT AS masks FROM f GROUP BY ALL""")
def frame_consistency(spark, sf_dir):
    """Frames whose masks have other ids or boxes than those stored are refused."""
    df = _runs(spark, sf_dir)
    left, right = (df.where(F.col("run") == r).select("frame_id", "ordinal", F.col("id").alias(f"id_{r}"), F.col("box").alias(f"box_{r}")) for r in "ac")
    off = left.join(right, ["frame_id", "ordinal"], "full").where("NOT (id_a <=> id_c AND box_a <=> box_c)")
    frames = df.select("frame_id").distinct().join(off.groupBy("frame_id").agg(F.count("*").alias("off")), "frame_id", "left").withColumn("off", F.coalesce("off", F.lit(0)))
    return frames.groupBy((F.col("off") > 0).alias("refused")).agg(F.count("*").alias("frames"), F.sum("off").alias("masks"))


_VOTES = f"""{_B}, votes AS (SELECT frame, x1, y1, x2, y2, ordinal, dense_class, 'a' AS run, a AS bucket, raw_a AS raw FROM b UNION ALL SELECT frame, x1, y1, x2, y2, ordinal, dense_class, 'b', b, raw_b FROM b WHERE px % 9 <> 0
 UNION ALL SELECT frame, x1, y1, x2, y2, ordinal, dense_class, 'c', CASE WHEN px % 2 = 0 THEN a ELSE b END, CASE WHEN px % 2 = 0 THEN raw_a ELSE raw_b END FROM b WHERE px % 7 <> 0),
 entries AS (SELECT frame, x1, y1, x2, y2, run, arg_max(bucket, ordinal) AS bucket, arg_max(raw, ordinal) AS raw, arg_max(dense_class, ordinal) AS dense_class FROM votes GROUP BY ALL)"""


def _entries(spark, sf_dir) -> DataFrame:
    """Three runs' answers by box (of several on one box the last); runs b and c lack some."""
    df = _bucketed(spark, sf_dir)
    even = F.col("px") % 2 == 0
    rows = F.array(F.struct(F.lit("a").alias("run"), F.col("a").alias("bucket"), F.col("raw_a").alias("raw"), F.lit(True).alias("seen")), F.struct(F.lit("b").alias("run"), F.col("b").alias("bucket"), F.col("raw_b").alias("raw"), (F.col("px") % 9 != 0).alias("seen")),
                   F.struct(F.lit("c").alias("run"), F.when(even, F.col("a")).otherwise(F.col("b")).alias("bucket"), F.when(even, F.col("raw_a")).otherwise(F.col("raw_b")).alias("raw"), (F.col("px") % 7 != 0).alias("seen")))
    votes = df.select("frame", "box", "ordinal", "dense_class", F.inline(rows)).where("seen")
    last = votes.groupBy("frame", "box", "run").agg(F.max_by(F.struct("bucket", "raw", "dense_class"), "ordinal").alias("e"))
    return last.select("frame", "box", "run", "e.*")


@query(f"""{_VOTES}, m AS (SELECT frame, x1, y1, list_sort(list(run) FILTER (bucket = 'confirmed')) AS yes FROM entries GROUP BY frame, x1, y1, x2, y2 HAVING count(*) = 3)
 SELECT CASE WHEN coalesce(len(yes), 0) = 0 THEN 'neither' WHEN len(yes) = 3 THEN 'both' ELSE yes[1] || '_only' END AS stratum, count(*) AS n FROM m GROUP BY ALL""")
def candidates_of_all_runs(spark, sf_dir):
    """Candidates that every run has on the same box, by the runs that confirmed them."""
    yes = F.sort_array(F.collect_list(F.when(F.col("bucket") == "confirmed", F.col("run"))))
    boxes = _entries(spark, sf_dir).groupBy("frame", "box").agg(F.count("*").alias("runs"), yes.alias("yes")).where(F.col("runs") == len(RUNS))
    return boxes.groupBy(R.confirmation_stratum(F.col("yes"), len(RUNS)).alias("stratum")).agg(F.count("*").alias("n"))


_CLASS_ID = r"CASE WHEN dense_class = 1 THEN 2 WHEN dense_class = 2 THEN 3 WHEN bucket = 'confirmed' AND regexp_replace(lower(regexp_replace(raw, '^\s+|\s+$', '', 'g')), '\.+$', '') <> 'cyclist' THEN 5 ELSE 4 END"


@query(f"{_VOTES} SELECT run, dense_class, bucket, {_CLASS_ID} AS class_id, count(*) AS n FROM entries GROUP BY ALL")
def discovered_classes(spark, sf_dir):
    df = _entries(spark, sf_dir)
    return df.groupBy("run", "dense_class", "bucket", R.discovered_class(F.col("dense_class"), F.col("raw"), F.col("bucket") == "confirmed").alias("class_id")).agg(F.count("*").alias("n"))


_RESOLVED = f"""{_VOTES}, resolved AS (SELECT frame, x1, y1, x2, y2, CASE WHEN count(DISTINCT {_CLASS_ID}) = 1 THEN min({_CLASS_ID}) END AS class_id FROM entries WHERE bucket = 'confirmed' GROUP BY frame, x1, y1, x2, y2)"""


def _resolved(spark, sf_dir) -> DataFrame:
    """By box the class that all runs which confirmed it gave it; none where they differ."""
    named = R.discovered_class(F.col("dense_class"), F.col("raw"), F.lit(True))
    ids = _entries(spark, sf_dir).where("bucket = 'confirmed'").groupBy("frame", "box").agg(F.collect_set(named).alias("ids"))
    return ids.select("frame", "box", F.when(F.size("ids") == 1, F.get("ids", 0)).alias("class_id"))


@query(f"{_RESOLVED} SELECT class_id, count(*) AS boxes FROM resolved GROUP BY ALL")
def resolved_classes(spark, sf_dir):
    return _resolved(spark, sf_dir).groupBy("class_id").agg(F.count("*").alias("boxes"))


@query(f"{_RESOLVED} SELECT dense_class, CASE dense_class WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE r.class_id END AS class_id, count(*) AS n FROM b LEFT JOIN resolved r USING (frame, x1, y1, x2, y2) WHERE px % 3 <> 0 GROUP BY ALL")
def human_candidates_by_class(spark, sf_dir):
    """Candidates that a human kept: vehicle and sign have their class, human ones what the runs resolve, else none."""
    df = _bucketed(spark, sf_dir).where("px % 3 <> 0").join(_resolved(spark, sf_dir), ["frame", "box"], "left")
    kind = F.col("dense_class")
    return df.groupBy("dense_class", F.when(kind == 1, 2).when(kind == 2, 3).otherwise(F.col("class_id")).alias("class_id")).agg(F.count("*").alias("n"))


# --- geometry of candidates -------------------------------------------------------------------------------------

_GEOMETRY = f"""{_B}, t AS (SELECT frame, ordinal, unnest(CASE WHEN px % 5 = 0 THEN [] ELSE [ordinal - 1, ordinal + 2, 9999] END) AS other FROM b), n AS (SELECT t.frame, t.ordinal, t.other, o.dense_class AS oc FROM t LEFT JOIN b o ON o.frame = t.frame AND o.ordinal = t.other),
 g AS (SELECT b.frame, b.ordinal, b.dense_class, CASE WHEN px % 4 = 0 THEN 'fringe' ELSE 'standalone' END AS kind, px % 3 <> 0 AS kept, CASE WHEN count(other) = 0 THEN 'none' WHEN coalesce(bool_or(oc = dense_class), false) THEN 'same' ELSE 'other' END AS against, count(other) - count(oc) AS unresolved
  FROM b LEFT JOIN n USING (frame, ordinal) GROUP BY b.frame, b.ordinal, b.dense_class, b.px),
 k AS (SELECT *, CASE WHEN against = 'same' THEN CASE WHEN kept THEN 'boundary growth' ELSE 'edge bleed' END WHEN kept THEN 'new object' ELSE 'false alarm' END AS geometry FROM g)"""


def _geometry(spark, sf_dir) -> DataFrame:
    """Candidates with what they lie against (same class, other, none) and the outcome; ids that don't resolve are counted and ignored."""
    df = _bucketed(spark, sf_dir).withColumn("kind", F.when(F.col("px") % 4 == 0, "fringe").otherwise("standalone")).withColumn("kept", F.col("px") % 3 != 0)
    cell = F.when(F.col("px") % 5 == 0, "[]").otherwise(F.to_json(F.array(F.col("ordinal") - 1, F.col("ordinal") + 2, F.lit(9999))))
    touching = df.select("frame", "ordinal", "dense_class", "kind", "kept", F.explode_outer(F.from_json(cell, "array<int>")).alias("other"))
    known = df.select("frame", F.col("ordinal").alias("other"), F.col("dense_class").alias("other_class"))
    met = touching.join(known, ["frame", "other"], "left").groupBy("frame", "ordinal", "dense_class", "kind", "kept").agg(
        F.count("other").alias("touching"), F.count("other_class").alias("resolved"), F.coalesce(F.bool_or(F.col("other_class") == F.col("dense_class")), F.lit(False)).alias("same"))
    against = F.when(F.col("touching") == 0, "none").when(F.col("same"), "same").otherwise("other")
    out = met.withColumn("against", against).withColumn("unresolved", F.col("touching") - F.col("resolved"))
    return out.withColumn("geometry", R.geometry(F.col("against") == "same", F.col("kept")))


@query(f"{_GEOMETRY} SELECT kind, against, kept, count(*) AS n, 100 * count(*) / sum(count(*)) OVER () AS percent, sum(unresolved)::BIGINT AS unresolved FROM k GROUP BY kind, against, kept")
def geometry_by_kind(spark, sf_dir):
    """Kinds against the verdict and against the class test."""
    out = _geometry(spark, sf_dir).groupBy("kind", "against", "kept").agg(F.count("*").alias("n"), F.sum("unresolved").alias("unresolved"))
    return out.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


@query(f"{_GEOMETRY} SELECT dense_class, geometry, count(*) AS n, 100 * count(*) / sum(count(*)) OVER (PARTITION BY dense_class) AS percent FROM k GROUP BY dense_class, geometry")
def geometry_by_class(spark, sf_dir):
    out = _geometry(spark, sf_dir).groupBy("dense_class", "geometry").agg(F.count("*").alias("n"))
    return out.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("dense_class")))


_LATE = "late AS (SELECT frame, row_number() OVER (ORDER BY max(px), frame) AS rank FROM b GROUP BY frame)"


@query(f"{_GEOMETRY}, {_LATE} SELECT w AS last, geometry, count(*) AS n FROM k JOIN late USING (frame), (SELECT unnest([20, 40]) AS w) WHERE rank > (SELECT max(rank) FROM late) - w GROUP BY ALL")
def geometry_of_last_frames(spark, sf_dir):
    """The outcome over the last frames of the order only, for two windows."""
    df = _geometry(spark, sf_dir)
    order = _bucketed(spark, sf_dir).groupBy("frame").agg(F.max("px").alias("at"))
    ranked = H.ranked(order, F.floor(F.col("at") / 50), "at", "frame")
    last = ranked.crossJoin(ranked.agg(F.max("rank").alias("top"))).withColumn("last", F.explode(F.array(F.lit(20), F.lit(40)))).where(F.col("rank") > F.col("top") - F.col("last"))  # one row
    return df.join(last.select("frame", "last"), "frame").groupBy("last", "geometry").agg(F.count("*").alias("n"))


# --- the cascade of judges on raw replies ------------------------------------------------------------------------

_ATT = f"""attempts AS (SELECT *, CASE WHEN alpha_bp % 6 = 0 THEN '?????' WHEN alpha_bp % 6 = 1 THEN 'no idea' WHEN alpha_bp % 6 = 2 THEN 'It is unclear' WHEN alpha_bp % 6 = 3 THEN 'a road' ELSE class_name END AS r1,
 CASE WHEN lidar_pm % 4 = 0 THEN NULL WHEN lidar_pm % 4 = 1 THEN '...' WHEN lidar_pm % 4 = 2 THEN 'no' ELSE class_name || 's.' END AS r2 FROM regions WHERE NOT prefiltered)"""
_SAID = "CASE WHEN {0} = class_name OR {0} = class_name || 's.' THEN 'valid' WHEN {0} = 'a road' THEN 'background' END"
_CASCADE = f"""WITH {REGIONS}, {_ATT}, v AS (SELECT *, {_SAID.format('r1')} AS v1, {_SAID.format('r2')} AS v2 FROM attempts),
 o AS (SELECT *, coalesce(v1, v2, 'valid') AS bbox, v1 IS NULL AND v2 IS NULL AS failed, v1 IS NULL AND v2 IS NULL AND (r2 IS NULL OR r2 = '...') AS degenerate FROM v),
 d AS (SELECT *, {decide_sql('bbox', 'quality', 'consistency')} AS decision FROM o)"""


def _cascade(spark, sf_dir) -> DataFrame:
    """All judges of a mask: two attempts at the box, the default where both fail; quality and consistency need no model."""
    c = F.col
    n = c("alpha_bp") % 6
    first = F.when(n == 0, "?????").when(n == 1, "no idea").when(n == 2, "It is unclear").when(n == 3, "a road").otherwise(c("class_name"))
    m = c("lidar_pm") % 4
    second = F.when(m == 0, None).when(m == 1, "...").when(m == 2, "no").otherwise(F.concat(c("class_name"), F.lit("s.")))
    df = regions(spark, sf_dir).where("NOT prefiltered").withColumn("replies", F.array(first, second))
    df = df.withColumn("outcome", R.attempt_value(c("replies"), lambda raw: R.parse_label(raw, c("class_name")), "valid"))
    df = df.withColumn("failures", F.when(c("outcome.parse_failed"), F.create_map(F.lit("bbox"), F.struct(c("outcome.degenerate").alias("degenerate"), c("outcome.raw").alias("raw")))))
    return df.withColumn("decision", R.decide(c("outcome.value"), c("quality"), c("consistency")))


@query(f"{_CASCADE} SELECT class_name, bbox, decision, failed AS degraded, degenerate, count(*) AS n, count(*) FILTER (bypass) AS bypassed, count(*)::BIGINT AS calls FROM d GROUP BY ALL")
def judge_cascade(spark, sf_dir):
    """Decisions with substituted defaults marked; a high score is recorded as a bypass, but no judge is skipped."""
    df = _cascade(spark, sf_dir)
    degraded = F.size(F.coalesce("failures", F.create_map().cast("map<string,struct<degenerate:boolean,raw:string>>"))) > 0
    return df.groupBy("class_name", F.col("outcome.value").alias("bbox"), "decision", degraded.alias("degraded"), F.col("outcome.degenerate").alias("degenerate")).agg(F.count("*").alias("n"), count_if(F.col("bypass")).alias("bypassed"), F.sum(F.lit(1).cast("long")).alias("calls"))


@query(f"{_CASCADE} SELECT class_name, count(*) AS total, count(*) FILTER (failed) AS defaults, count(*) FILTER (degenerate) AS degenerate, count(*) FILTER (bbox = 'valid' AND NOT failed) AS valid_answered, count(*) FILTER (decision = 'reject') AS rejected FROM d GROUP BY class_name")
def run_mask_stats(spark, sf_dir):
    """Of a run: defaults, degenerate ones, and verdicts without defaults; decisions are made again from the verdicts."""
    df = _cascade(spark, sf_dir)
    failed = F.col("failures").isNotNull() & F.map_contains_key(F.coalesce("failures", F.create_map().cast("map<string,struct<degenerate:boolean,raw:string>>")), "bbox")
    bad = F.size(F.coalesce(I.failed_signals(F.col("failures")), F.array().cast("array<string>"))) > 0
    return df.groupBy("class_name").agg(F.count("*").alias("total"), count_if(failed).alias("defaults"), count_if(bad).alias("degenerate"), count_if((F.col("outcome.value") == "valid") & ~failed).alias("valid_answered"), count_if(F.col("decision") == "reject").alias("rejected"))


@query(f"{_CASCADE}, bad AS (SELECT DISTINCT frame_id FROM d WHERE degenerate) SELECT count(DISTINCT frame_id) AS frames, count(*) AS masks FROM d ANTI JOIN bad USING (frame_id)")
def pruned_frames(spark, sf_dir):
    """What stays without the frames that hold a degenerate reply."""
    df = _cascade(spark, sf_dir)
    return I.pruned(df, df.where(F.col("outcome.degenerate"))).agg(F.count_distinct("frame_id").alias("frames"), F.count("*").alias("masks"))


@query(f"{_ORDER}, d AS (SELECT dense_rank() OVER (ORDER BY frame_id) - 1 AS code, rank FROM r) SELECT count(*) AS frames, max(code) AS top, sum(code * (rank % 7))::BIGINT AS mark FROM d")
def frame_codes(spark, sf_dir):
    """Dense codes of frames in the order of their names, as resampling uses them."""
    order = _order(regions(spark, sf_dir)).select("frame_id", F.col("rank").alias("place"))
    coded = H.ranked(order, F.substring("frame_id", 1, 14), "frame_id", name="code").withColumn("code", F.col("code") - 1)
    return coded.agg(F.count("*").alias("frames"), F.max("code").alias("top"), F.sum(F.col("code") * (F.col("place") % 7)).alias("mark"))


@query(f"WITH {DISCOVERIES} SELECT dense_class, round(px / ((x2 - x1 + 1) * (y2 - y1 + 1)), 3) > 0.5 AS filled, count(*) AS n FROM discoveries GROUP BY ALL")
def fill_ratios(spark, sf_dir):
    """Share of a candidate's inclusive box that its pixels fill, to three places."""
    b = F.col
    area = (b("box.x2") - b("box.x1") + 1) * (b("box.y2") - b("box.y1") + 1)
    return discoveries(spark, sf_dir).groupBy("dense_class", (F.round(b("px") / area, 3) > 0.5).alias("filled")).agg(F.count("*").alias("n"))

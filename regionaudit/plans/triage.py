"""Decisions and rules over regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators.human import confusion, count_if, rates
from ..sources.fixtures import REGIONS, decide_sql, regions
from .registry import query

_Q = "CASE WHEN alpha_bp >= 3000 THEN 'good' ELSE quality END"
_L = "CASE WHEN lidar_pm >= CASE class_name WHEN 'vehicle' THEN 100 ELSE 50 END THEN 'pass' ELSE 'fail' END"
_NEG = f"bbox_a IN ('invalid', 'background') OR ({_Q}) = 'bad' OR consistency = 'fail'"
VARIANTS_SQL = {
    "raw_sam": "'accept'",
    "swin_only": "CASE WHEN alpha_bp < 3000 THEN 'reject' ELSE 'accept' END",
    "vlm_only": decide_sql("bbox_a", "NULL", "consistency"),
    "triage": decide_sql("bbox_a", f"({_Q})", "consistency"),
    "swin_protected": decide_sql("bbox_a", f"({_Q})", "consistency"),
    "with_bypass": decide_sql("(CASE WHEN bypass THEN 'valid' ELSE bbox_a END)", f"(CASE WHEN bypass THEN 'good' ELSE ({_Q}) END)", "consistency"),
    "disjunctive_reject": f"CASE WHEN coalesce({_NEG}, false) THEN 'reject' ELSE 'accept' END",
    "uniform_tau": decide_sql("bbox_a", "(CASE WHEN alpha_bp >= 3000 THEN 'good' ELSE 'bad' END)", "consistency"),
    "background_protected": decide_sql("bbox_a", f"({_Q})", "consistency", True),
    "lidar_class_aware": decide_sql("bbox_a", f"({_Q})", f"({_L})"),
    "limits_fixed": decide_sql("bbox_a", f"({_Q})", f"({_L})", True),
}
_ALL = " UNION ALL ".join(f"SELECT *, '{n}' AS variant, {e} AS decision FROM regions" for n, e in VARIANTS_SQL.items())
VARIANT_ROWS = f"WITH {REGIONS}, v AS ({_ALL})"


def variant_rows(df: DataFrame, rules: dict | None = None) -> DataFrame:
    """All rules in one projection, then a row for each rule."""
    entries = F.array(*[F.struct(F.lit(n).alias("variant"), e.alias("decision")) for n, e in (rules or R.variants()).items()])
    return df.select("*", F.inline(entries))


def signatures(df: DataFrame, *keys: str) -> DataFrame:
    """Regions that no rule tells apart as one row: n, px, and a score and support that stand for theirs.

    Rules are then applied to some hundred rows, however many regions there are.
    """
    c = F.col
    told = [(c("alpha_bp") >= R.UNIFORM_QUALITY_BP).alias("over"), c("lidar_pm").isNull().alias("unmeasured"), R.consistency_verdict(c("lidar_pm"), R.by_class(R.LIDAR_PM, R.UNIFORM_LIDAR_PM)).alias("support")]
    grouped = df.groupBy("class_name", "bbox_a", "quality", "consistency", "bypass", *told, *keys)
    return grouped.agg(F.min("alpha_bp").alias("alpha_bp"), F.min("lidar_pm").alias("lidar_pm"), F.count("*").alias("n"), F.sum("pixel_count").alias("px"))


@query(f"WITH {REGIONS} SELECT class_name, stored_a AS decision, count(*) AS n, sum(pixel_count)::BIGINT AS px FROM regions GROUP BY ALL")
def triage_matrix(spark, sf_dir):
    return regions(spark, sf_dir).groupBy("class_name", F.col("stored_a").alias("decision")).agg(F.count("*").alias("n"), F.sum("pixel_count").alias("px"))


@query(f"{VARIANT_ROWS} SELECT variant, class_name, decision, count(*) AS n FROM v GROUP BY ALL")
def variant_decisions(spark, sf_dir):
    return variant_rows(signatures(regions(spark, sf_dir))).groupBy("variant", "class_name", "decision").agg(F.sum("n").alias("n"))


@query(f"""WITH {REGIONS} SELECT variant, decision, count(*) AS n FROM (SELECT unnest(['raw_sam', 'swin_only', 'triage']) AS variant,
 unnest(['accept', CASE WHEN alpha_bp < CASE class_name WHEN 'cyclist' THEN 1500 WHEN 'pedestrian' THEN 1500 ELSE 3000 END THEN 'reject' ELSE 'accept' END, stored_a]) AS decision FROM regions) GROUP BY ALL""")
def live_variants(spark, sf_dir):
    return variant_rows(regions(spark, sf_dir), R.live_variants()).groupBy("variant", "decision").agg(F.count("*").alias("n"))


_RATES = """(tp + tn) / (tp + fp + fn + tn) AS accuracy, CASE WHEN tp > 0 THEN tp / (tp + fp) END AS "precision", CASE WHEN tp > 0 THEN tp / (tp + fn) END AS recall,
 CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1, fp / nullif(fp + tn, 0) AS bad_kept, fn / nullif(tp + fn, 0) AS good_lost"""
_CELLS = """count(*) FILTER (keep AND ok) AS tp, count(*) FILTER (keep AND NOT ok) AS fp, count(*) FILTER (NOT keep AND ok) AS fn, count(*) FILTER (NOT keep AND NOT ok) AS tn"""


@query(f"{VARIANT_ROWS}, c AS (SELECT variant, {_CELLS} FROM (SELECT variant, decision <> 'reject' AS keep, human = 'correct' AS ok FROM v WHERE human IS NOT NULL) GROUP BY variant) SELECT *, {_RATES} FROM c")
def variant_scores_vs_human(spark, sf_dir):
    df = variant_rows(signatures(regions(spark, sf_dir).where("human IS NOT NULL"), "human"))
    return rates(confusion(df, F.col("decision") != "reject", F.col("human") == "correct", "variant", weight=F.col("n")))


@query(f"{VARIANT_ROWS}, w AS (SELECT v.*, {VARIANTS_SQL['triage']} AS base FROM v) SELECT variant, class_name, base, decision, count(*) AS n, sum(pixel_count)::BIGINT AS px FROM w GROUP BY ALL")
def variant_transitions(spark, sf_dir):
    df = signatures(regions(spark, sf_dir)).withColumn("base", R.variants()["triage"])
    return variant_rows(df).groupBy("variant", "class_name", "base", "decision").agg(F.sum("n").alias("n"), F.sum("px").alias("px"))


_ASPECT = "((lidar_pm % 97 + 1) / (alpha_bp % 29 + 1))"


@query(f"""WITH {REGIONS} SELECT class_name, CASE WHEN {_ASPECT} > 4.5 OR {_ASPECT} < 0.12 OR pixel_count < CASE class_name WHEN 'vehicle' THEN 30 ELSE 15 END THEN 'reject' END AS verdict, count(*) AS n FROM regions GROUP BY ALL""")
def prefilter_verdicts(spark, sf_dir):
    aspect = (F.col("lidar_pm") % 97 + 1) / (F.col("alpha_bp") % 29 + 1)
    return regions(spark, sf_dir).groupBy("class_name", R.prefilter_verdict(aspect, F.col("pixel_count")).alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""WITH {REGIONS} SELECT CASE WHEN bbox_a IS NULL AND quality IS NULL THEN 'prefilter' WHEN bbox_a = 'background' THEN 'background' WHEN bbox_a = 'invalid' AND consistency = 'pass' THEN 'invalid_confirmed'
 WHEN bbox_a = 'invalid' AND quality = 'bad' THEN 'invalid_bad' WHEN bbox_a = 'invalid' AND consistency = 'fail' THEN 'invalid_fail' WHEN quality = 'bad' AND consistency = 'fail' THEN 'bad_fail' ELSE 'other' END AS cause, count(*) AS n FROM regions WHERE stored_a = 'reject' GROUP BY ALL""")
def reject_causes(spark, sf_dir):
    return regions(spark, sf_dir).where("stored_a = 'reject'").groupBy(R.reject_cause().alias("cause")).agg(F.count("*").alias("n"))


@query(f"""WITH {REGIONS} SELECT CASE WHEN bbox_a = 'invalid' THEN 'invalid' WHEN quality = 'bad' THEN 'bad' WHEN consistency = 'fail' THEN 'fail' ELSE 'other' END AS cause, count(*) AS n FROM regions WHERE stored_a = 'human_review' GROUP BY ALL""")
def review_causes(spark, sf_dir):
    return regions(spark, sf_dir).where("stored_a = 'human_review'").groupBy(R.review_cause().alias("cause")).agg(F.count("*").alias("n"))


@query(f"""WITH {REGIONS} SELECT class_name, count(*) AS n, sum(alpha_bp)::BIGINT AS sum_bp, quantile_cont(alpha_bp, 0.5)::DOUBLE AS median_bp, count(*) FILTER (quality = 'bad') AS under_bar, count(*) FILTER (bypass) AS over_bypass FROM regions GROUP BY ALL""")
def score_distribution(spark, sf_dir):
    return regions(spark, sf_dir).groupBy("class_name").agg(F.count("*").alias("n"), F.sum("alpha_bp").alias("sum_bp"), F.percentile("alpha_bp", F.lit(0.5)).alias("median_bp"), count_if(F.col("quality") == "bad").alias("under_bar"), count_if(F.col("bypass")).alias("over_bypass"))


@query(f"""WITH {REGIONS} SELECT least(alpha_bp // 1500, 6)::BIGINT AS bin, count(*) AS n FROM regions GROUP BY ALL""")
def agreement_histogram(spark, sf_dir):
    return regions(spark, sf_dir).groupBy(F.least(F.floor(F.col("alpha_bp") / 1500), F.lit(6)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {REGIONS} SELECT CASE WHEN pixel_count < 100 THEN 'tiny' WHEN pixel_count < 300 THEN 'small' WHEN pixel_count < 1000 THEN 'medium' ELSE 'large' END AS size,
 CASE WHEN alpha_bp < 100 THEN 'none' WHEN alpha_bp < 5000 THEN 'low' WHEN alpha_bp < 9900 THEN 'high' ELSE 'full' END AS agreement,
 CASE WHEN lidar_pm < 10 THEN 'none' WHEN lidar_pm < 400 THEN 'low' WHEN lidar_pm < 800 THEN 'medium' ELSE 'high' END AS support, count(*) AS n FROM regions GROUP BY ALL""")
def region_bands(spark, sf_dir):
    c = F.col
    return regions(spark, sf_dir).groupBy(
        R.band(c("pixel_count"), (100, 300, 1000), ("tiny", "small", "medium", "large")).alias("size"),
        R.band(c("alpha_bp"), (100, 5000, 9900), ("none", "low", "high", "full")).alias("agreement"),
        R.band(c("lidar_pm"), (10, 400, 800), ("none", "low", "medium", "high")).alias("support"),
    ).agg(F.count("*").alias("n"))


@query(f"""WITH {REGIONS} SELECT class_name, count(*) AS n, count(*) FILTER (bbox_a IS NOT NULL AND bbox_b IS NOT NULL) AS answered, count(*) FILTER (bbox_a = bbox_b) AS agreed,
 count(*) FILTER (bbox_a = bbox_b) / nullif(count(*) FILTER (bbox_a IS NOT NULL AND bbox_b IS NOT NULL), 0) AS rate FROM regions GROUP BY ALL""")
def run_agreement(spark, sf_dir):
    both = F.col("bbox_a").isNotNull() & F.col("bbox_b").isNotNull()
    out = regions(spark, sf_dir).groupBy("class_name").agg(F.count("*").alias("n"), count_if(both).alias("answered"), count_if(F.col("bbox_a") == F.col("bbox_b")).alias("agreed"))
    return out.withColumn("rate", F.try_divide("agreed", "answered"))


def _runs(spark, sf_dir):
    """The two runs as relations of their own; run b lacks some masks and has others' scores shifted."""
    df = regions(spark, sf_dir)
    a = df.select("frame_id", "mask_id", F.col("alpha_bp").alias("alpha_a"), "stored_a")
    b = df.where("lidar_pm % 50 <> 0").select("frame_id", "mask_id", (F.col("alpha_bp") + (F.col("lidar_pm") % 40 == 1).cast("int")).alias("alpha_b"), "stored_b")
    return a, b


@query(f"""WITH {REGIONS}, a AS (SELECT frame_id, mask_id, alpha_bp FROM regions), b AS (SELECT frame_id, mask_id, alpha_bp + (lidar_pm % 40 = 1)::INT AS alpha_b FROM regions WHERE lidar_pm % 50 <> 0)
 SELECT count(*) FILTER (b.frame_id IS NULL) AS only_a, count(*) FILTER (a.frame_id IS NULL) AS only_b, count(*) FILTER (alpha_bp <> alpha_b) AS score_mismatches FROM a FULL JOIN b ON a.frame_id = b.frame_id AND a.mask_id = b.mask_id""")
def input_identity(spark, sf_dir):
    a, b = _runs(spark, sf_dir)
    both = a.withColumn("in_a", F.lit(1)).join(b.withColumn("in_b", F.lit(1)), ["frame_id", "mask_id"], "full")
    return both.agg(count_if(F.col("in_b").isNull()).alias("only_a"), count_if(F.col("in_a").isNull()).alias("only_b"), count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & ~F.col("alpha_a").eqNullSafe(F.col("alpha_b"))).alias("score_mismatches"))


@query(f"""WITH {REGIONS} SELECT class_name, count(*) AS n, count(*) FILTER (stored_a <> stored_b) AS moved, count(*) FILTER ((stored_a = 'reject') <> (stored_b = 'reject')) AS flipped,
 coalesce(sum(pixel_count) FILTER ((stored_a = 'reject') <> (stored_b = 'reject')), 0)::BIGINT AS px FROM regions GROUP BY ALL""")
def label_divergence(spark, sf_dir):
    flip = (F.col("stored_a") == "reject") != (F.col("stored_b") == "reject")
    return regions(spark, sf_dir).groupBy("class_name").agg(F.count("*").alias("n"), count_if(F.col("stored_a") != F.col("stored_b")).alias("moved"), count_if(flip).alias("flipped"), F.sum(F.when(flip, F.col("pixel_count")).otherwise(0)).alias("px"))


@query(f"""WITH {REGIONS} SELECT count(*) AS judged, count(*) FILTER (bbox_a <> bbox_b) AS verdict_diff, count(*) FILTER (stored_a <> stored_b) AS state_diff, count(*) FILTER ((stored_a = 'reject') <> (stored_b = 'reject')) AS flip,
 count(*) FILTER (bbox_a = bbox_b AND (stored_a = 'reject') <> (stored_b = 'reject')) AS flip_same_verdict FROM regions WHERE bbox_a IS NOT NULL""")
def cascade(spark, sf_dir):
    c = F.col
    flip = (c("stored_a") == "reject") != (c("stored_b") == "reject")
    return regions(spark, sf_dir).where("bbox_a IS NOT NULL").agg(F.count("*").alias("judged"), count_if(c("bbox_a") != c("bbox_b")).alias("verdict_diff"), count_if(c("stored_a") != c("stored_b")).alias("state_diff"), count_if(flip).alias("flip"), count_if((c("bbox_a") == c("bbox_b")) & flip).alias("flip_same_verdict"))


@query(f"WITH {REGIONS} SELECT class_name, bbox_a, bbox_b, count(*) AS n FROM regions WHERE bbox_a IS NOT NULL AND bbox_b IS NOT NULL GROUP BY ALL")
def bbox_transitions(spark, sf_dir):
    return regions(spark, sf_dir).where("bbox_a IS NOT NULL AND bbox_b IS NOT NULL").groupBy("class_name", "bbox_a", "bbox_b").agg(F.count("*").alias("n"))


@query(f"""WITH {REGIONS} SELECT CASE stored_a WHEN 'human_review' THEN 'retained' ELSE stored_a END AS a, CASE stored_b WHEN 'human_review' THEN 'retained' ELSE stored_b END AS b, count(*) AS n, sum(pixel_count)::BIGINT AS px FROM regions GROUP BY ALL""")
def outcome_transitions(spark, sf_dir):
    return regions(spark, sf_dir).groupBy(R.pooled(F.col("stored_a")).alias("a"), R.pooled(F.col("stored_b")).alias("b")).agg(F.count("*").alias("n"), F.sum("pixel_count").alias("px"))


_DA, _DB = decide_sql("bbox_a", f"({_Q})", "consistency"), decide_sql("bbox_b", f"({_Q})", "consistency")
_CONSENSUS = f"""WITH {REGIONS}, r AS (SELECT *, {_DA} AS da, {_DB} AS db0, lidar_pm % 50 <> 0 AS in_b FROM regions), p AS (SELECT class_name, da, CASE WHEN in_b THEN db0 ELSE da END AS db FROM r)
 SELECT class_name, CASE WHEN {{rule}} THEN 'reject' WHEN da = 'reject' THEN 'human_review' ELSE da END AS decision, count(*) AS n FROM p GROUP BY ALL"""


def _consensus(spark, sf_dir, rejected):
    """Run a keeps its decision unless the rule rejects; a rejection by run a alone is sent to review; masks that run b lacks go by a."""
    rule_b = R.variants(bbox="bbox_b")["triage"]
    df = regions(spark, sf_dir).withColumn("da", R.variants()["triage"]).withColumn("db", F.when(F.col("lidar_pm") % 50 != 0, rule_b).otherwise(F.col("da")))
    a, b = F.col("da") == "reject", F.col("db") == "reject"
    return df.groupBy("class_name", F.when(rejected(a, b), "reject").when(a, "human_review").otherwise(F.col("da")).alias("decision")).agg(F.count("*").alias("n"))


@query(_CONSENSUS.format(rule="da = 'reject' AND db = 'reject'"))
def consensus_union(spark, sf_dir):
    return _consensus(spark, sf_dir, lambda a, b: a & b)


@query(_CONSENSUS.format(rule="da = 'reject' OR db = 'reject'"))
def consensus_intersection(spark, sf_dir):
    return _consensus(spark, sf_dir, lambda a, b: a | b)


@query(f"""WITH {REGIONS}, c AS (SELECT class_name, {_CELLS} FROM (SELECT class_name, bbox_a = 'valid' AS keep, quality = 'good' AS ok FROM regions WHERE bbox_a IS NOT NULL) GROUP BY class_name)
 SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, fp / nullif(fp + tn, 0) AS bad_kept, fn / nullif(tp + fn, 0) AS good_lost FROM c""")
def dense_reference_scores(spark, sf_dir):
    df = regions(spark, sf_dir).where("bbox_a IS NOT NULL")
    return rates(confusion(df, F.col("bbox_a") == "valid", F.col("quality") == "good", "class_name"), zeros=True)


@query(f"""WITH {REGIONS}, s AS (SELECT count(*) AS total, count(*) FILTER (NOT (lidar_pm % 7 = 0 AND NOT prefiltered)) AS answered_a, count(*) FILTER (bbox_a = 'valid' AND lidar_pm % 7 <> 0) AS valid_answered_a, count(*) FILTER (bbox_b = 'valid') AS valid_recorded_b FROM regions)
 SELECT *, 100 * valid_answered_a / answered_a AS least_a, 100 * valid_recorded_b / total AS most_b, CASE WHEN valid_answered_a * total > valid_recorded_b * answered_a THEN 'a is more permissive' ELSE 'inconclusive' END AS verdict FROM s""")
def permissiveness_bound(spark, sf_dir):
    """Run a tells which verdicts are substituted defaults (valid), run b does not.

    Defaults only push a rate up, so b's rate of valid answers is at most its recorded one; a is more permissive if its rate
    over answered masks is above that.  Masks that were filtered before count as they are recorded.
    """
    c = F.col
    defaulted = (c("lidar_pm") % 7 == 0) & ~c("prefiltered")
    out = regions(spark, sf_dir).agg(F.count("*").alias("total"), count_if(~defaulted).alias("answered_a"), count_if((c("bbox_a") == "valid") & ~defaulted).alias("valid_answered_a"), count_if(c("bbox_b") == "valid").alias("valid_recorded_b"))
    above = c("valid_answered_a") * c("total") > c("valid_recorded_b") * c("answered_a")
    return out.select("*", (100 * c("valid_answered_a") / c("answered_a")).alias("least_a"), (100 * c("valid_recorded_b") / c("total")).alias("most_b"), F.when(above, "a is more permissive").otherwise("inconclusive").alias("verdict"))


def _sweep_sql(lidar: str, large: str, small: str) -> str:
    q = f"(CASE WHEN alpha_bp >= CASE WHEN class_name IN ('cyclist', 'pedestrian') THEN {small} ELSE {large} END THEN 'good' ELSE 'bad' END)"
    return decide_sql("bbox_a", q, f"(CASE WHEN lidar_pm >= {lidar} THEN 'pass' ELSE 'fail' END)")


_SWEPT = "count(*) FILTER (human = 'incorrect') AS bad, count(*) FILTER (human = 'incorrect' AND d <> 'reject') AS bad_kept, count(*) FILTER (human = 'correct') AS good, count(*) FILTER (human = 'correct' AND d = 'reject') AS good_deleted"


def _swept(df, lidar, large, small, by):
    c = F.col
    bar = F.when(c("class_name").isin("cyclist", "pedestrian"), small).otherwise(large)
    d = R.decide(c("bbox_a"), F.when(c("alpha_bp") >= bar, "good").otherwise("bad"), F.when(c("lidar_pm") >= lidar, "pass").otherwise("fail"))
    bad = c("human") == "incorrect"
    return df.withColumn("d", d).groupBy(by).agg(count_if(bad).alias("bad"), count_if(bad & (c("d") != "reject")).alias("bad_kept"), count_if(~bad).alias("good"), count_if(~bad & (c("d") == "reject")).alias("good_deleted"))


@query(f"WITH {REGIONS}, s AS (SELECT tau, human, {_sweep_sql('tau', '3000', '1500')} AS d FROM regions, (SELECT unnest([0, 50, 100, 150, 200, 300]) AS tau) WHERE human IS NOT NULL) SELECT tau, {_SWEPT} FROM s GROUP BY tau")
def lidar_sweep(spark, sf_dir):
    df = regions(spark, sf_dir).where("human IS NOT NULL").withColumn("tau", F.explode(F.array(*[F.lit(t) for t in (0, 50, 100, 150, 200, 300)])))
    return _swept(df, F.col("tau"), F.lit(3000), F.lit(1500), "tau")


@query(f"WITH {REGIONS}, s AS (SELECT scale, human, {_sweep_sql('100', '(3000 * scale // 100)', '(1500 * scale // 100)')} AS d FROM regions, (SELECT unnest([50, 100, 150, 200]) AS scale) WHERE human IS NOT NULL) SELECT scale, {_SWEPT} FROM s GROUP BY scale")
def scale_sweep(spark, sf_dir):
    df = regions(spark, sf_dir).where("human IS NOT NULL").withColumn("scale", F.explode(F.array(*[F.lit(t) for t in (50, 100, 150, 200)])))
    return _swept(df, F.lit(100), F.floor(3000 * F.col("scale") / 100), F.floor(1500 * F.col("scale") / 100), "scale")


@query(f"""WITH {REGIONS}, b AS (SELECT class_name, frame_id, mask_id, alpha_bp, row_number() OVER (PARTITION BY frame_id ORDER BY alpha_bp, mask_id) AS r FROM regions WHERE stored_a <> stored_b),
 t AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY alpha_bp, frame_id, mask_id) AS turn, count(*) OVER (PARTITION BY class_name) AS size FROM b WHERE r = 1)
 SELECT class_name, frame_id, mask_id, turn FROM t ORDER BY turn, size DESC, class_name LIMIT 40""")
def top_candidates_round_robin(spark, sf_dir):
    from ..operators.select import round_robin

    df = regions(spark, sf_dir).where("stored_a <> stored_b").select("class_name", "frame_id", "mask_id", "alpha_bp")
    return round_robin(df, "frame_id", "class_name", -F.col("alpha_bp"), "mask_id", 40).select("class_name", "frame_id", "mask_id", F.col("turn").cast("long"))


@query(f"""WITH {REGIONS}, f AS (SELECT frame_id, row_number() OVER (ORDER BY frame_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT frame_id FROM regions))
 SELECT frame_id FROM f, range(100) t(i) WHERE pos = floor(i * n / 100)""")
def stride_sample(spark, sf_dir):
    from ..operators.select import stride

    return stride(regions(spark, sf_dir).select("frame_id").distinct(), "frame_id", 100, F.substring("frame_id", 1, 14))


@query(f"WITH {REGIONS} SELECT frame_id, class_name, sum(pixel_count)::BIGINT AS px FROM regions GROUP BY ALL")
def class_pixel_counts(spark, sf_dir):
    return regions(spark, sf_dir).groupBy("frame_id", "class_name").agg(F.sum("pixel_count").alias("px"))


@query(f"WITH {REGIONS}, s AS (SELECT weather, class_name, sum(pixel_count)::BIGINT AS px, count(DISTINCT frame_id) AS frames FROM regions GROUP BY ALL) SELECT *, px / sum(px) OVER (PARTITION BY class_name) AS share FROM s")
def split_shares(spark, sf_dir):
    out = regions(spark, sf_dir).groupBy("weather", "class_name").agg(F.sum("pixel_count").alias("px"), F.count_distinct("frame_id").alias("frames"))
    return out.withColumn("share", F.col("px") / F.sum("px").over(Window.partitionBy("class_name")))


@query("""WITH s AS (SELECT o_orderpriority AS weather, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT unnest([0, 1, 2]) AS i, unnest(['train', 'validation', 'test']) AS split, unnest([65, 10, 25]) AS ratio),
 q AS (SELECT weather, split, n, i, n * ratio // 100 AS f, n * ratio % 100 AS rest FROM s, r)
 SELECT weather, split, (f + (row_number() OVER (PARTITION BY weather ORDER BY rest DESC, i) <= n - sum(f) OVER (PARTITION BY weather))::INT)::BIGINT AS quota FROM q""")
def apportion(spark, sf_dir):
    from ..operators.splits import apportion as shares

    sizes = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("weather")).agg(F.count("*").alias("n"))
    return shares(sizes, "weather", "n", {"train": 65, "validation": 10, "test": 25})


@query()
def balanced_splits(spark, sf_dir):
    """Split search by weather over all of its frames: quotas are exact in each weather, classes are balanced over it."""
    from ..operators.splits import balanced
    from ..session import ship

    ship(spark)
    df = regions(spark, sf_dir).groupBy("frame_id", "weather").pivot("class_name", list(R.CLASSES)).agg(F.sum("pixel_count")).na.fill(0)
    return balanced(df, "weather", list(R.CLASSES), {"train": 0.65, "validation": 0.1, "test": 0.25})

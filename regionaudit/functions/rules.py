"""Signals, decision rules and parsers as Column expressions; three-valued signals are compared null-safely."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
CLASSES = ("vehicle", "sign", "cyclist", "pedestrian")
MIN_PIXELS = {"vehicle": 30, "sign": 15, "cyclist": 15, "pedestrian": 15}
QUALITY_BP = {"vehicle": 3000, "sign": 3000, "cyclist": 1500, "pedestrian": 1500}
BYPASS_BP = {"vehicle": 7000, "sign": 7000, "cyclist": 4000, "pedestrian": 4000}
LIDAR_PM = {"vehicle": 100, "sign": 50, "cyclist": 50, "pedestrian": 50}
UNIFORM_QUALITY_BP, UNIFORM_LIDAR_PM = 3000, 100
ASPECT_LOW, ASPECT_HIGH = 0.12, 4.5
STRONG_DISTRACTORS = ("road", "building", "vegetation", "sky")
WEAK_DISTRACTORS = ("traffic_light", "traffic_sign", "pole", "unclear")


#: Raw weather to condition; null: rain, by the time of day.
WEATHER = {
    "clear-day": "day_fair", "partly-cloudy-day": "day_fair", "cloudy": "day_fair", "wind": "day_fair", "fog": "day_fair",
    "clear-night": "night_fair", "partly-cloudy-night": "night_fair", "snow": "snow", "rain": None,
}


def weather(raw: Column, time_of_day: Column) -> Column:
    """Condition of a frame: values that are not known are rain, a missing time is day."""
    out = F.when(F.coalesce(time_of_day, F.lit("day")) == "day", "day_rain").otherwise("night_rain")
    for value, condition in WEATHER.items():
        out = F.when(raw == value, condition).otherwise(out) if condition else out
    return out


def discovered_class(dense_class: Column, raw: Column, confirmed: Column) -> Column:
    """Class id of a candidate: vehicle 2, sign 3, a confirmed cyclist 4 and other confirmed human 5; not confirmed ones 4."""
    return F.when(dense_class == 1, 2).when(dense_class == 2, 3).when(confirmed & (normal_reply(raw) != "cyclist"), 5).otherwise(4)


def by_class(values: dict[str, int], default: int, name: Column | str = "class_name") -> Column:
    out = F.lit(default)
    for c, v in values.items():
        out = F.when(F.col(name) == c, v).otherwise(out) if isinstance(name, str) else F.when(name == c, v).otherwise(out)
    return out


def is_(column: Column | str, value: str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).eqNullSafe(F.lit(value))


def quality_verdict(alpha: Column, bar: Column) -> Column:
    """good from the class bar on; a missing score is good."""
    return F.when(alpha.isNull() | (alpha >= bar), "good").otherwise("bad")


def consistency_verdict(support: Column, bar: int | Column = UNIFORM_LIDAR_PM) -> Column:
    return F.when(F.coalesce(support, F.lit(0)) >= bar, "pass").otherwise("fail")


def prefilter_verdict(aspect: Column, pixels: Column) -> Column:
    """reject for extreme shapes and small regions, else null."""
    return F.when((aspect > ASPECT_HIGH) | (aspect < ASPECT_LOW) | (pixels < by_class(MIN_PIXELS, 15)), "reject")


def decide(bbox: Column, quality: Column, consistency: Column, protect_background: bool = False) -> Column:
    """Two negative votes reject, three positive signals accept, all else goes to a human.

    ``invalid`` counts twice if LiDAR confirms content and quality doesn't vouch for it; ``background`` counts
    twice, or only where quality doesn't vouch if ``protect_background``.
    """
    vote = lambda c: c.cast("int")
    unvouched = ~is_(quality, "good")
    background = is_(bbox, "background")
    negatives = vote(is_(bbox, "invalid")) + vote(is_(bbox, "invalid") & is_(consistency, "pass") & unvouched)
    negatives = negatives + vote(background) + (vote(background & unvouched) if protect_background else vote(background))
    negatives = negatives + vote(is_(quality, "bad")) + vote(is_(consistency, "fail"))
    positive = is_(bbox, "valid") & is_(quality, "good") & is_(consistency, "pass")
    return F.when(negatives >= 2, "reject").when(positive, "accept").otherwise("human_review")


def any_negative(bbox: Column, quality: Column, consistency: Column) -> Column:
    return is_(bbox, "invalid") | is_(bbox, "background") | is_(quality, "bad") | is_(consistency, "fail")


def variants(bar: int = UNIFORM_QUALITY_BP, bbox: str = "bbox_a") -> dict[str, Column]:
    """All replayed rules over stored columns: bbox, quality, consistency, alpha_bp, lidar_pm, bypass, class_name."""
    b, q, c, alpha = F.col(bbox), F.col("quality"), F.col("consistency"), F.col("alpha_bp")
    replayed = F.when(alpha >= bar, "good").otherwise(q)
    by_lidar = F.when(F.col("lidar_pm").isNull(), c).otherwise(consistency_verdict(F.col("lidar_pm"), by_class(LIDAR_PM, UNIFORM_LIDAR_PM)))
    bypass = F.coalesce(F.col("bypass"), F.lit(False))
    full = decide(b, replayed, c)
    return {
        "raw_sam": F.lit("accept"),
        "swin_only": F.when(alpha < bar, "reject").otherwise("accept"),
        "vlm_only": decide(b, F.lit(None).cast("string"), c),
        "triage": full,
        "swin_protected": full,
        "with_bypass": decide(F.when(bypass, "valid").otherwise(b), F.when(bypass, "good").otherwise(replayed), c),
        "disjunctive_reject": F.when(any_negative(b, replayed, c), "reject").otherwise("accept"),
        "uniform_tau": decide(b, F.when(alpha.isNull(), q).when(alpha >= bar, "good").otherwise("bad"), c),
        "background_protected": decide(b, replayed, c, True),
        "lidar_class_aware": decide(b, replayed, by_lidar),
        "limits_fixed": decide(b, replayed, by_lidar, True),
    }


def live_variants() -> dict[str, Column]:
    """Rules of the online stage: per-class bars and the stored decision."""
    return {
        "raw_sam": F.lit("accept"),
        "swin_only": F.when(F.col("alpha_bp") < by_class(QUALITY_BP, UNIFORM_QUALITY_BP), "reject").otherwise("accept"),
        "triage": F.col("stored_a"),
    }


def pooled(decision: Column) -> Column:
    """accept, reject or retained: the archived value refine and human_review are one outcome."""
    return F.when(decision.isin("refine", "human_review"), "retained").otherwise(decision)


def reject_cause() -> Column:
    b, q, c = F.col("bbox_a"), F.col("quality"), F.col("consistency")
    return (
        F.when(b.isNull() & q.isNull(), "prefilter").when(is_(b, "background"), "background").when(is_(b, "invalid") & is_(c, "pass"), "invalid_confirmed")
        .when(is_(b, "invalid") & is_(q, "bad"), "invalid_bad").when(is_(b, "invalid") & is_(c, "fail"), "invalid_fail").when(is_(q, "bad") & is_(c, "fail"), "bad_fail").otherwise("other")
    )


def review_cause() -> Column:
    return F.when(is_("bbox_a", "invalid"), "invalid").when(is_("quality", "bad"), "bad").when(is_("consistency", "fail"), "fail").otherwise("other")


def band(value: Column, edges: tuple[float, ...], labels: tuple[str, ...]) -> Column:
    """The label of the first edge above the value, else the last; unknown if null."""
    out = F.when(value.isNull(), "unknown")
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(value < edge, label)
    return out.otherwise(labels[-1])


def degenerate(raw: Column) -> Column:
    """Without any letter or digit, or null."""
    return raw.isNull() | ~raw.rlike(r"[\p{L}\p{N}]")


def normal_reply(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(raw, r"^\s+|\s+$", "")), r"\.+$", "")


def discovery_bucket(raw: Column, dense_class: Column) -> Column:
    said = normal_reply(raw)
    confirmed = ((dense_class == 1) & (said == "vehicle")) | ((dense_class == 2) & (said == "sign")) | ((dense_class == 3) & said.isin("cyclist", "pedestrian"))
    return F.when(degenerate(raw), "no-response").when(confirmed, "confirmed").when(said == "other", "other").otherwise("unanswered")


def parse_label(raw: Column, expected: Column) -> Column:
    """valid, invalid, background, or null where nothing or something unclear was named."""
    low = F.lower(raw)
    names = lambda t: low.rlike(rf"\b{t}s?\b")
    some = F.lit(False)
    for t in (*CLASSES, *STRONG_DISTRACTORS, *WEAK_DISTRACTORS):
        some = some | names(t)
    asked = F.lit(False)
    for c in CLASSES:
        asked = asked | ((expected == c) & names(c))
    strong = F.lit(False)
    for t in STRONG_DISTRACTORS:
        strong = strong | names(t)
    return (
        F.when(raw.isNull() | ~some | names("unclear"), None).when(asked | ((expected == "sign") & names("traffic_light")), "valid").when(strong, "background").otherwise("invalid")
    )


def first_token(raw: Column, tokens: tuple[str, ...]) -> Column:
    """The first of the tokens that the reply contains as a substring."""
    out = F.lit(None).cast("string")
    for t in reversed(tokens):
        out = F.when(F.lower(raw).contains(t), t).otherwise(out)
    return out


RAW_CHARS = 120


def attempt_value(attempts: Column, parse: Callable[[Column], Column], default: str) -> Column:
    """From an array of raw replies: the first that parses, else the safe default; parse_failed, degenerate and raw tell of the last reply then."""
    good = F.filter(F.transform(attempts, parse), lambda v: v.isNotNull())
    failed, last = F.size(good) == 0, F.element_at(attempts, -1)
    return F.struct(F.coalesce(F.get(good, 0), F.lit(default)).alias("value"), failed.alias("parse_failed"), (failed & degenerate(last)).alias("degenerate"), F.when(failed, F.substring(last, 1, RAW_CHARS)).alias("raw"))


def decider(bbox: str, quality: str) -> Column:
    """What decided on a mask: the filter before the judges, the dense score alone, or the model."""
    b, q = F.col(bbox), F.col(quality)
    return F.when(b.isNull() & q.isNull(), "prefilter").when(b.isNull(), "dense_only").otherwise("model")


def confirmation_stratum(yes: Column, runs: int) -> Column:
    """neither, both (all runs) or the first of the sorted runs that confirmed, as ``<run>_only``."""
    return F.when(F.size(yes) == 0, "neither").when(F.size(yes) == runs, "both").otherwise(F.concat(F.get(yes, 0), F.lit("_only")))


def geometry(same_class: Column, kept: Column) -> Column:
    """Outcome of a candidate by whether it lies against its own class and whether a human kept it."""
    return F.when(same_class & kept, "boundary growth").when(same_class, "edge bleed").when(kept, "new object").otherwise("false alarm")


def fold_class(name: Column) -> Column:
    return F.when(name.isin("cyclist", "pedestrian"), "human").otherwise(name)


def mock_reply(payload: Column, prompt: Column, vocabulary: tuple[str, ...]) -> Column:
    """A deterministic reply: the first 16 bits of an MD5 digest choose from the vocabulary."""
    at = F.conv(F.substring(F.md5(F.concat(F.substring(payload, 1, 256), prompt)), 1, 4), 16, 10).cast("int") % len(vocabulary)
    return F.element_at(F.array(*[F.lit(v) for v in vocabulary]), at + 1)


def box_iou(a: str, b: str) -> Column:
    """Intersection over union of inclusive boxes given as struct columns x1, y1, x2, y2."""
    c = F.col
    w = F.greatest(F.lit(0), F.least(c(f"{a}.x2"), c(f"{b}.x2")) - F.greatest(c(f"{a}.x1"), c(f"{b}.x1")) + 1)
    h = F.greatest(F.lit(0), F.least(c(f"{a}.y2"), c(f"{b}.y2")) - F.greatest(c(f"{a}.y1"), c(f"{b}.y1")) + 1)
    area = lambda p: (c(f"{p}.x2") - c(f"{p}.x1") + 1) * (c(f"{p}.y2") - c(f"{p}.y1") + 1)
    return F.try_divide(w * h, area(a) + area(b) - w * h)

"""Rule-based reranking: what a query asks for, how a hit meets it, a clamped change of its score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbridge.functions.hashing import clamp, overlaps
from tarnbridge.functions.text import contains_any, strip

#: Words that tell of other navigation, of puncture protection and of wide gearing.
OTHER_NAVIGATION = ("wahoo", "hammerhead", "bryton", "karoo", "coros")
PUNCTURE = ("tubeless", "sealant", "plugs", "dynaplug", "dart", "cushcore", "inserts")
WIDE_GEARING = ("10-52", "10-50", "11-51", "11-50", "11-46", "11-42", "mullet")
#: Terms of a query and the event key that they hint at, first match counts.
EVENT_HINTS = (("transcontinental", "transcontinental"), ("tcr", "transcontinental"), ("gb duro", "gbd"), ("gbduro", "gbd"))


@dataclass(frozen=True)
class Weights:
    """Change of the score for each rule, and the most that all rules change it."""

    event_match: float = 0.02
    mechanical_ok: float = 0.02
    electronic_violation: float = -0.02
    garmin_ok: float = 0.02
    garmin_violation: float = -0.02
    rigid_ok: float = 0.01
    suspension_violation: float = -0.02
    tyre_match: float = 0.02
    tyre_mismatch: float = -0.02
    puncture_terms: float = 0.01
    wide_gearing_terms: float = 0.01
    has_structured: float = 0.005
    most: float = 0.05

    @classmethod
    def of(cls, config: dict) -> Weights:
        """From a configuration whose names may begin with w_; an unknown name is an error."""
        names = {"w_has_structured_fields": "has_structured", "max_rule_delta_abs": "most"}
        return cls(**{names.get(k, k.removeprefix("w_")): float(v) for k, v in config.items() if k != "oversample"})


def constraints(query: Column) -> dict[str, Column]:
    """What a query asks for, from its words."""
    q = F.lower(query)
    mechanical = contains_any(q, ["mechanical shifting", "mechanical only"])
    no_suspension = contains_any(q, ["avoid suspension", "no suspension"])
    both = r"(?i)(\d{2})\s*[-–]\s*(\d{2})\s*mm"
    low, high, least = (F.regexp_extract(q, p, i).try_cast("int") for p, i in ((both, 1), (both, 2), (r"(?i)(\d{2})\s*mm\+", 1)))
    inches = r"""(?i)(\d(?:\.\d)?)\s*[-–]\s*(\d(?:\.\d)?)\s*['"]"""
    low_inch, high_inch = (F.regexp_extract(q, inches, i).try_cast("double") for i in (1, 2))
    hint = F.lit(None).cast("string")
    for term, key in reversed(EVENT_HINTS):
        hint = F.when(q.contains(term), key).otherwise(hint)
    return {
        "avoid_electronic": contains_any(q, ["avoid electronic", "no electronic"]) | mechanical,
        "require_garmin": contains_any(q, ["garmin only", "navigation: garmin", "nav: garmin"]),
        "rigid": q.contains("rigid") | no_suspension,
        "puncture": contains_any(q, ["puncture", "flat"]),
        "wide_gearing": contains_any(q, ["wide range gearing", "steep climbs", "wide gear range"]),
        "tyre_min": F.coalesce(low, least), "tyre_max": high, "tyre_min_inch": low_inch, "tyre_max_inch": high_inch, "event_hint": hint,
    }


def tyre_range(width: Column) -> tuple[Column, Column]:
    """Least and greatest mm of a tyre width: 50mm+, 40mm - 45mm, 40-45mm or 45mm."""
    s = F.lower(strip(width))
    open_ = F.regexp_extract(s, r"^(\d+)mm\+$", 1).try_cast("int")
    found = lambda p, i: F.regexp_extract(s, p, i).try_cast("int")
    pair, short, one = r"(\d{2})\s*mm\s*-\s*(\d{2})\s*mm", r"(\d{2})\s*-\s*(\d{2})\s*mm", r"(\d{2})\s*mm"
    ends_open = s.endswith("mm+")
    low = F.when(ends_open, open_).otherwise(F.coalesce(found(pair, 1), found(short, 1), found(one, 1)))
    high = F.when(~ends_open, F.coalesce(found(pair, 2), found(short, 2), found(one, 1)))
    return low, high


def rule_deltas(asked: dict[str, Column], hit: dict[str, Column], w: Weights) -> dict[str, Column]:
    """Change for each rule that applies, 0 for the others.

    hit has text, event_key, frame_type, tyre_width, wheel_size and electronic; asked is what
    constraints() gives.
    """
    text, frame = F.lower(F.coalesce(hit["text"], F.lit(""))), F.lower(F.coalesce(hit["frame_type"], F.lit("")))
    low, high = tyre_range(F.coalesce(hit["tyre_width"], F.lit("")))
    wants_tyre = asked["tyre_min"].isNotNull() | asked["tyre_max"].isNotNull()
    fits = overlaps(asked["tyre_min"], asked["tyre_max"], low, high)
    known = low.isNotNull() | high.isNotNull()
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    on = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    hint = asked.get("event_hint", F.lit(None).cast("string"))
    return {
        "event": on(F.coalesce(hint != "", F.lit(False)) & F.lower(F.coalesce(hit["event_key"], F.lit(""))).contains(hint), w.event_match),
        "electronic": F.when(asked["avoid_electronic"] & hit["electronic"], F.lit(w.electronic_violation)).when(asked["avoid_electronic"] & ~hit["electronic"], F.lit(w.mechanical_ok)).otherwise(F.lit(0.0)),
        "garmin": F.when(asked["require_garmin"] & text.contains("garmin"), F.lit(w.garmin_ok)).when(asked["require_garmin"] & contains_any(text, OTHER_NAVIGATION), F.lit(w.garmin_violation)).otherwise(F.lit(0.0)),
        "rigid": F.when(asked["rigid"] & frame.contains("suspension"), F.lit(w.suspension_violation)).when(asked["rigid"] & (frame != ""), F.lit(w.rigid_ok)).otherwise(F.lit(0.0)),
        "tyre": F.when(wants_tyre & known & fits, F.lit(w.tyre_match)).when(wants_tyre & known, F.lit(w.tyre_mismatch)).otherwise(F.lit(0.0)),
        "puncture": on(asked["puncture"] & contains_any(text, PUNCTURE), w.puncture_terms),
        "gearing": on(asked["wide_gearing"] & contains_any(text, WIDE_GEARING), w.wide_gearing_terms),
        "structured": on(filled(hit["frame_type"]) | filled(hit["wheel_size"]) | filled(hit["tyre_width"]) | F.coalesce(hit["electronic"], F.lit(False)), w.has_structured),
    }


def rerank(hits: DataFrame, asked: dict[str, Column], hit: dict[str, Column], weights: Weights = Weights()) -> DataFrame:  # noqa: B008
    """Adds delta, total and place: score plus clamped changes, best first, equals as they were."""
    delta = clamp(sum(rule_deltas(asked, hit, weights).values(), F.lit(0.0)), -weights.most, weights.most)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("total", 9)), "pos")
    return hits.withColumn("delta", delta).withColumn("total", F.col("score") + F.col("delta")).withColumn("place", F.row_number().over(order))

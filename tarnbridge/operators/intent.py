"""What a query is about: surface, keywords, kind of event, component asked for, and descriptors."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbridge.functions.text import contains_any, count_of
from tarnbridge.operators.event_names import is_event_name

#: Terms of roads and of gravel in queries, and markers in texts about riders.
ROAD_TERMS = ("road race", "road ultra", "endurance road", "road bikepacking", "all road", "transiberica")
GRAVEL_TERMS = ("gravel", "gravel race", "off road", "singletrack", "mtb", "mountain bike")
ROAD_MARKS = ("road bike", "endurance bike", "endurace", "domane", "emonda", "700c", "28mm", "30mm", "32mm", "slick")
GRAVEL_MARKS = ("gravel", "grx", "650b", "hardtail", "mtb", "mountain bike", "29er", "27.5", "suspension")
#: Keywords by flag.
FLAGS = {
    "road": ("road race", "paved", "tarmac", "asphalt", "road ultra", "road cycling"),
    "gravel": ("gravel", "gravel race", "dirt road", "fire road", "unbound"),
    "mtb": ("mtb", "mountain bike", "singletrack", "technical", "rocky", "hardtail", "full suspension", "29er", "trail bike"),
    "off_road": ("off-road", "off road", "singletrack", "track", "rocky", "trail", "technical", "jeep track", "doubletrack", "rough terrain", "dirt road"),
    "desert": ("desert", "sahara", "arid", "dry", "sand"),
    "mountain": ("mountain", "alpine", "climb", "elevation", "pass", "high mountains"),
    "remote": ("remote", "self-supported", "self supported", "unsupported", "no services", "minimal resupply"),
    "night": ("night", "dark", "overnight"),
    "cold_hot": ("temperature", "cold", "hot", "heat", "freezing", "temperature swings"),
    "navigation": ("navigation", "gps", "route", "track", "waypoint", "gpx"),
}
#: Terms by component, in order of precedence.
COMPONENTS = {
    "lights": ("light", "lights", "lighting", "dynamo", "dynamo hub", "son", "supernova", "k-lite", "klite", "exposure", "rear light", "front light"),
    "tyres": ("tyre", "tyres", "tire", "tires", "tubeless", "casing", "width", "2.2", "2.35", "continental", "gp5000", "maxxis", "ardent", "nobby nic", "schwalbe", "g-one"),
    "bags": ("bag", "bags", "frame bag", "seat pack", "handlebar roll", "cargo", "apidura", "tailfin", "ortlieb", "restrap", "geosmina"),
    "sleep_system": ("sleep", "sleep system", "bivy", "bivvy", "quilt", "sleeping bag", "mat", "pad"),
    "drivetrain": ("drivetrain", "groupset", "group set", "group", "cassette", "chainring", "gearing", "gear ratio", "grx", "sram", "shimano"),
    "wheels": ("wheel", "wheels", "rim", "rims", "hub", "hubs", "wheelset"),
    "bike_type": ("bike", "bike type", "frame", "hardtail", "gravel bike", "mtb", "mountain bike", "road", "custom build"),
}
#: What is said of each surface and flag.
SURFACE_WORDS = {
    "road": ("road ultra race", "paved"), "gravel": ("gravel ultra race", "mixed dirt roads"),
    "mtb": ("MTB mountain bike ultra", "rough off-road terrain"), "mixed_offroad": ("off-road bikepacking ultra", "mixed rough terrain"),
}
FLAG_WORDS = {
    "mountain": "mountainous long climbs", "desert": "desert arid", "remote": "remote minimal resupply",
    "night": "night riding", "navigation": "navigation GPS route", "cold_hot": "temperature swings",
}
#: What is said of known events, and kinds of event that are near each other.
EVENT_HINTS = {
    "transiberica": ("road ultra race", "endurance road bikepacking", "long distance across Spain or Europe", "lightweight setup", "heat"),
    "atlas mountain race": ("mountainous", "off-road", "remote", "night riding", "long climbs"),
    "gb duro": ("off-road bikepacking ultra", "mountainous", "remote", "rough terrain"),
    "silk road mountain race": ("mountainous", "mtb ultra", "remote", "high altitude", "rough terrain"),
    "tour divide": ("off-road bikepacking ultra", "long distance", "remote", "mixed dirt roads"),
    "badlands": ("gravel ultra race", "arid", "heat", "remote"),
}
ADJACENT = {
    "mountain_gravel_ultra": ("gravel_ultra", "mountain_offroad_ultra"), "gravel_ultra": ("mountain_gravel_ultra", "offroad_bikepacking_ultra"), "mountain_road_ultra": ("road_ultra",), "road_ultra": ("mountain_road_ultra",),
    "desert_mtb_ultra": ("mountain_mtb_ultra", "desert_offroad_ultra"), "mountain_mtb_ultra": ("mtb_ultra", "mountain_offroad_ultra"), "mtb_ultra": ("mountain_mtb_ultra", "offroad_bikepacking_ultra"),
    "desert_offroad_ultra": ("mountain_offroad_ultra", "desert_mtb_ultra"), "mountain_offroad_ultra": ("offroad_bikepacking_ultra", "mountain_mtb_ultra"),
}
#: What flags say of terrain, environment and format; every event is an ultra.
DETAILS = {
    "terrain": (("mountain", "mountainous"),),
    "environment": (("desert", "desert"), ("remote", "remote"), ("cold_hot", "temperature_swings")),
    "format": ((None, "ultra"), ("remote", "self_supported"), ("night", "night_riding"), ("navigation", "navigation_heavy")),
}
FIRST_WORDS = "self-supported ultra endurance bikepacking race"
#: Patterns of setup details, the first that matches counts.
SETUP = {
    "wheels": (r"\benve [^|,;]+wheels?\b", r"\bninth wave [^|,;]+wheels?\b", r"\bzipp [^|,;]+wheels?\b", r"\b650b\b", r"\b700c\b", r"\b29(?:er)?\b", r"\b27\.5\b"),
    "tyres": (r"\bschwalbe [^|,;]+\b", r"\btufo [^|,;]+\b", r"\brene herse [^|,;]+\b", r"\bconti(?:nental)? [^|,;]+\b", r"\b\d{2}\s?mm\b", r"\b650x\d+[a-z]?c?\b", r"\b700x\d+[a-z]?c?\b"),
    "drivetrain": (r"\bshimano [^|,;]+", r"\bsram [^|,;]+", r"\bgrx [^|,;]+", r"\bxtr [^|,;]+", r"\b105 rd-r\d+[^\|,;]*", r"\b\d{1,2}\s?x\s?\d{2}(?:-\d{2})?\b", r"\b\d{2}-\d{2}\/\d{2}-\d{2}\b"),
    "bags": (
        r"\bapidura [^|,;]*bags?\b", r"\brestrap [^|,;]*bags?\b", r"\btailfin [^|,;]*bags?\b", r"\bortlieb [^|,;]*bags?\b", r"\brevelate [^|,;]*bags?\b", r"\bframe bag\b", r"\bsaddle bag\b",
        r"\bsaddlebag\b", r"\bseat pack\b", r"\btop tube bag\b", r"\bhandlebar bag\b", r"\bdrybag\b", r"\bcargo pack\b",
    ),
    "sleep_system": (r"\byeti sleeping bag\b", r"\bsleeping bag\b", r"\bair mattress\b", r"\bmattress\b", r"\bquilt\b", r"\btent\b", r"\bbivy\b", r"\bbivvy\b", r"\bbivi\b", r"\bmat\b"),
}


def surface_bias(query: Column, road_hint: Column | None = None) -> Column:
    """road, gravel or neutral: which terms occur more; a road event's hint counts three."""
    road = count_of(query, ROAD_TERMS) + (F.when(road_hint, 3).otherwise(0) if road_hint is not None else 0)
    gravel = count_of(query, GRAVEL_TERMS)
    return F.when(road > gravel, "road").when(gravel > road, "gravel").otherwise("neutral")


def surface_factor(text: Column, bias: Column) -> Column:
    """How much a rider's score is raised or lowered for the surface."""
    road, gravel = contains_any(text, ROAD_MARKS), contains_any(text, GRAVEL_MARKS)
    on_road = F.when(road & ~gravel, 1.15).when(gravel & ~road, 0.72).when(road & gravel, 0.92).otherwise(1.0)
    on_gravel = F.when(gravel & ~road, 1.15).when(road & ~gravel, 0.80).when(road & gravel, 0.95).otherwise(1.0)
    return F.when(bias == "road", on_road).when(bias == "gravel", on_gravel).otherwise(1.0)


def surface_hint(query: Column) -> Column:
    q = F.concat(F.lit(" "), F.lower(query), F.lit(" "))
    return (
        F.when(contains_any(q, [" road ", " all-road ", " all road "]), "road").when(q.contains(" gravel "), "gravel")
        .when(contains_any(q, [" trail ", " mtb ", " mountain bike "]), "trail")
    )


def flags(text: Column) -> dict[str, Column]:
    return {name: contains_any(F.lower(text), terms) for name, terms in FLAGS.items()}


def with_flags(rows: DataFrame, text: Column) -> DataFrame:
    """Rows with a column a flag, so that what builds on flags several times doesn't read the text each time.

    The text is lowered once a row, in a projection of its own.
    """
    low = rows.withColumn("_lower", F.lower(text))
    return low.withColumns({name: contains_any(F.col("_lower"), terms) for name, terms in FLAGS.items()}).drop("_lower")


def surface_family(f: dict[str, Column]) -> Column:
    return F.when(f["mtb"], "mtb").when(f["gravel"], "gravel").when(f["road"], "road").when(f["off_road"], "mixed_offroad").otherwise("unknown")


def archetype(f: dict[str, Column]) -> Column:
    """The kind of event that the flags tell of."""
    family = surface_family(f)
    climbs = lambda high, flat: F.when(f["mountain"], high).otherwise(flat)
    return (
        F.when(family == "mtb", F.when(f["desert"], "desert_mtb_ultra").otherwise(climbs("mountain_mtb_ultra", "mtb_ultra")))
        .when(family == "gravel", climbs("mountain_gravel_ultra", "gravel_ultra")).when(family == "road", climbs("mountain_road_ultra", "road_ultra"))
        .when(family == "mixed_offroad", F.when(f["desert"], "desert_offroad_ultra").otherwise(climbs("mountain_offroad_ultra", "offroad_bikepacking_ultra")))
        .otherwise("general_bikepacking_ultra")
    )


def archetype_details(f: dict[str, Column]) -> dict[str, Column]:
    """terrain, environment and format as lists, and the kinds of event next to the one that the flags tell of."""
    listed = lambda items: F.array_compact(F.array(*[F.lit(w) if flag is None else F.when(f[flag], w) for flag, w in items]))
    near = F.coalesce(*[F.when(archetype(f) == k, F.array(*map(F.lit, v))) for k, v in ADJACENT.items()], F.array().cast("array<string>"))
    return {name: listed(items) for name, items in DETAILS.items()} | {"adjacent": near}


def event_hints(event: Column) -> Column:
    """What is known of an event, by its name; an empty list for others."""
    name = F.lower(F.trim(event))
    return F.coalesce(*[F.when(name == k, F.array(*map(F.lit, v))) for k, v in EVENT_HINTS.items()], F.array().cast("array<string>"))


#: How a distance and an elevation are written, in any case.
KM, METRES = r"(?i)(\d{2,4})\s*km\b", r"(?i)(\d{3,5})\s*m\b"


def metric(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("int")


def descriptors(f: dict[str, Column], hint: Column, distance_km: Column, elevation_m: Column, event: Column | None = None) -> Column:
    """Distinct descriptors in order, joined by commas: the query for a broad search.

    event is a name; one that isn't an event's name adds nothing.
    """
    family = surface_family(f)
    for_hint = lambda name, *words: [F.when(hint == name, w) for w in words]
    named = event if event is not None else F.lit(None).cast("string")
    first = [
        F.lit(FIRST_WORDS), F.when(is_event_name(named), F.trim(named)),
        *for_hint("road", "road event", "road-oriented setup", "faster rolling tyres", "avoid MTB-style tyre widths"), *for_hint("gravel", "gravel event", "gravel-oriented setup"),
        *for_hint("trail", "trail event", "trail-oriented setup"),
    ]
    rest = [
        *[F.when(family == name, w) for name, words in SURFACE_WORDS.items() for w in words], *[F.when(f[name], w) for name, w in FLAG_WORDS.items()],
        F.when(distance_km > 0, F.concat(distance_km.cast("string"), F.lit(" km"))), F.when(elevation_m > 0, F.concat(elevation_m.cast("string"), F.lit(" m climbing"))),
    ]
    return F.array_join(F.array_distinct(F.array_compact(F.concat(F.array(*first), event_hints(named), F.array(*rest)))), ", ")


def component_counts(query: Column, terms: dict[str, Sequence[str]] | None = None) -> Column:
    """The component most of whose terms occur, the first of equals: a struct (n, order, name)."""
    q = F.lower(query)
    each = [F.struct(count_of(q, t).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, t) in enumerate((terms or COMPONENTS).items())]
    return F.array_max(F.array(*each))


def component(query: Column, best: Column) -> tuple[Column, Column]:
    """The component that a query asks for, and how sure that is; best is of component_counts()."""
    empty, n = F.trim(query) == "", best.getField("n")
    name = F.when(empty | (n == 0), "full_setup").otherwise(best.getField("name"))
    return name, F.when(empty, 0.0).when(n == 0, 0.25).otherwise(F.least(F.lit(1.0), 0.35 + 0.15 * n))


def bike_type(text: Column, lowered: Column | None = None) -> Column:
    t = F.lower(text) if lowered is None else lowered
    return (
        F.when(t.contains("hardtail"), "hardtail").when(contains_any(t, ["mountain bike", " mtb"]), "mtb").when(t.contains("gravel"), "gravel bike")
        .when(contains_any(t, ["road bike", "endurace", "domane", "emonda"]), "road / endurance bike")
    )


_NOT_PLAIN = re.compile(r"\(\?:[^)]*\)\??|\[[^\]]*\][*+?]?|\\[bds](?:\{[^}]*\})?[*+?]?|[^\\]\?")


def always_there(pattern: str) -> str:
    """The longest part of a pattern of SETUP that each match has as it stands, in lower case."""
    plain = re.sub(r"\\(.)", r"\1", _NOT_PLAIN.sub("\n", pattern))
    return max(plain.split("\n"), key=len)


def setup_detail(text: Column, patterns: Sequence[str], lowered: Column | None = None) -> Column:
    """What the first pattern that matches finds, as it is written in the text.

    lowered is the text in lower case, where the caller has it: a pattern is only tried on texts with its plain part.
    """
    low = F.lower(text) if lowered is None else lowered
    return F.coalesce(*[F.when(low.contains(always_there(p)), F.regexp_substr(text, F.lit(f"(?i){p}"))) for p in patterns])


def component_hit(text: Column, terms: Sequence[str]) -> Column:
    return contains_any(F.lower(text), terms)

"""Questions and coarse truths made from event names, for evaluating answers."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tarnbridge.functions.hashing import stable_id
from tarnbridge.functions.text import contains_any, normal_question, slug, without_year, year_in
from tarnbridge.operators.sync import first_by

#: Words of styles and surroundings in event names, and the distances that they name.
STYLES = {
    "road": ("audax road", "road", "liège", "lpl", "superbrevet", "supergrevet"), "gravel": ("gravel", "gx"), "trail": ("trail", "colorado trail"),
    "mixed": ("divide", "unknown", "balkan", "transatlantic"), "short": ("sprint", "quick bite"), "tough": ("monster", "accursed"),
}
SURROUNDINGS = (
    (("pyren", "alps", "peaks", "highland", "andes", "vercors"), ("mountains", "cold")), (("brevet", "audax", "xl", "ultra"), ("night", "power", "navigation")),
    (("british", "dales", "cotswolds", "celtic", "albion"), ("wet", "rain")), (("rwanda", "java", "fuego", "patagonia"), ("heat_or_extremes", "hydration")),
)
DISTANCE = r"\b(200|300|303|360|500|550|600)\b"
MUST_COVER = ("bike_type", "wheels", "tyres", "drivetrain", "bags", "sleep_system")
MUST_INCLUDE = ("tyres", "drivetrain", "bags")


def style(tags: Column) -> Column:
    has = lambda t: F.array_contains(tags, t)
    return (
        F.when(has("trail"), "trail").when(has("road") & ~has("gravel"), "road").when(has("gravel") & ~has("road"), "gravel")
        .when((has("road") & has("gravel")) | has("mixed"), "mixed").otherwise("unknown")
    )


def style_tags(event: Column) -> Column:
    e = F.lower(event)
    return F.array_compact(F.array(*[F.when(contains_any(e, words), F.lit(tag)) for tag, words in STYLES.items()]))


def surroundings(event: Column) -> Column:
    e = F.lower(event)
    return F.array_distinct(F.array_compact(F.array(*[F.when(contains_any(e, words), F.lit(t)) for words, tags in SURROUNDINGS for t in tags])))


def expectations(events: DataFrame, name: str, default_year: int) -> DataFrame:
    """Adds event, year, style, tags, must_include and must_avoid, from the name alone."""
    base = events.withColumns({"event": without_year(F.col(name)), "year": year_in(F.col(name), r"\b(20\d{2})\b", default_year), "km": F.regexp_extract(name, DISTANCE, 1).try_cast("int")})
    base = base.withColumn("_styles", style_tags(F.col("event"))).withColumn("style", style(F.col("_styles")))
    span = F.when(F.col("km") >= 500, "multi-day").when(F.col("km") >= 300, "overnight_possible").when(F.col("km").isNotNull(), "shorter")
    base = base.withColumn("tags", F.array_compact(F.concat(F.array_distinct(F.concat("_styles", surroundings(F.col("event")))), F.array(span))))
    has = lambda t: F.array_contains("tags", t)
    on = lambda c, *words: [F.when(c, F.lit(w)) for w in words]
    include = [
        *map(F.lit, MUST_INCLUDE), *on(F.col("km") >= 500, "lights", "power", "layers"), *on((F.col("km") >= 300) & (F.col("km") < 500), "nutrition", "spares"),
        *on(F.col("style") == "trail", "repair", "traction"), *on(has("mountains"), "low gears", "warm layers"), *on(has("wet") | has("rain"), "waterproof"),
        *on(has("night"), "navigation", "backup"), *on(has("hydration"), "hydration"),
    ]
    avoid = [*on(F.col("style") == "trail", "slick tyres", "time trial"), *on(F.col("style") == "road", "MTB tyres"), *on(has("short") | has("shorter"), "tent", "heavy sleeping bag")]
    unique = lambda items: F.array_distinct(F.array_compact(F.array(*items)))
    return base.withColumns({"must_cover": F.array(*map(F.lit, MUST_COVER)), "must_include": unique(include), "must_avoid": unique(avoid)}).drop("_styles")


def questions(events: DataFrame, templates: Sequence[str], suffixes: Sequence[str], per_event: int, seed: int) -> DataFrame:
    """per_event questions for each event and year (columns event, year), each question once.

    Templates hold {event} and {year}. Templates and suffixes are chosen by a hash of event, year and
    seed, so a run can be repeated and extended; every question after the first has a suffix.
    """
    once = first_by(events.withColumn("_key", F.concat_ws("__", slug(F.col("event")), F.col("year").cast("string"))), ["_key"], F.col("event"))
    h = lambda *c: F.xxhash64(F.lit(seed), F.col("_key"), *c)
    order = Window.partitionBy("_key").orderBy(h(F.col("template")), "template")
    forms = F.posexplode(F.array(*map(F.lit, templates))).alias("template", "form")
    picked = once.select("*", forms).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_event)
    suffix = F.element_at(F.array(*map(F.lit, suffixes)), (F.pmod(h(F.lit("suffix"), F.col("n")), F.lit(len(suffixes))) + 1).cast("int"))
    text = F.replace(F.replace("form", F.lit("{event}"), F.col("event")), F.lit("{year}"), F.col("year").cast("string"))
    rows = picked.withColumn("question", F.when(F.col("n") > 1, F.concat_ws(" ", text, suffix)).otherwise(text))
    rows = first_by(rows.withColumn("_normal", normal_question(F.col("question"))), ["_normal"], F.struct("event", "n"))
    return rows.withColumn("id", stable_id("gt", F.concat_ws("|", "event", "year", "question"))).drop("_key", "_normal", "form", "template")


#: Rounds of the keyed permutation.
ROUNDS = 6


def permuted(n: np.ndarray, key: np.ndarray, size: int) -> np.ndarray:
    """A permutation of 0 to size - 1 for each key, at places n: a Feistel network over an even number of bits, walked until it is in the range.

    The walk from a place in the range comes back to the range, as the network is a permutation of all numbers of so many bits.
    """
    half = max(1, -(-max(1, size - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    x, key = n.astype(np.uint64), key.astype(np.uint64)
    out, open_ = x.copy(), np.arange(len(x))
    while len(open_):
        left, right, k = out[open_] >> np.uint64(half), out[open_] & mask, key[open_]
        for r in range(ROUNDS):
            mixed = (right + k + np.uint64(0x9E3779B97F4A7C15 * (r + 1) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29)) ^ (k >> np.uint64(7 * r))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed >> np.uint64(33)) & mask)
        out[open_] = (left << np.uint64(half)) | right
        open_ = open_[out[open_] >= np.uint64(size)]
    return out.astype(np.int64)


def eval_queries(events: DataFrame, pools: dict[str, Sequence[str]], forms: Sequence[str], per_event: int, seed: int) -> DataFrame:
    """qid, event and query: per_event queries for each event, all of them chosen differently.

    A form holds {event} and the names of pools. Forms and pools have a product of choices, of which each event takes
    the first per_event in an order of its own, by a permutation keyed by event and seed, so none
    comes twice and nothing is drawn again. There are no more queries an event than choices; choices that read the same, as
    a form need not hold every pool, stay once (the first).
    """
    sizes = [len(forms), *(len(p) for p in pools.values())]
    total = math.prod(sizes)

    @F.pandas_udf(T.LongType())
    def choice(n: pd.Series, key: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series(permuted(n.to_numpy(), key.to_numpy(), total))

    rows = events.select("event").filter("event is not null").distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(total - 1))) if total <= per_event else F.explode(F.sequence(F.lit(0), F.lit(per_event - 1))))
    rows = rows.withColumn("_choice", choice(F.col("n").cast("bigint"), F.xxhash64(F.lit(seed), "event")))
    query, step = None, 1
    for name, pool in {"": forms, **pools}.items():
        own = F.element_at(F.array(*map(F.lit, pool)), (F.pmod(F.floor(F.col("_choice") / step), F.lit(len(pool))) + 1).cast("int"))
        query = F.replace(own, F.lit("{event}"), F.col("event")) if query is None else F.replace(query, F.lit("{" + name + "}"), own)
        step *= len(pool)
    rows = first_by(rows.withColumn("query", query), ["event", "query"], F.col("n"))
    return rows.withColumn("qid", stable_id("q", F.concat_ws("|", "event", F.col("n").cast("string"), "query"))).select("qid", "event", "query")

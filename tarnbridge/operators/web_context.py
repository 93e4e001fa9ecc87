"""What the web says about events: choosing pages among search results, context as records and text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbridge.functions.text import base_site, blank, contains_any, domain, joined_url, strip
from tarnbridge.operators.sync import first_by

#: Domains of social networks and of sites that list events, as parts of a name.
SOCIAL = ("facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "tiktok.com")
LISTINGS = ("granfondoguide.com", "bikepacking.com", "amateurultracycling.cc", "battistrada.com", "cycling-calendar")
TRACKERS = ("dotwatcher.cc",)
#: Where a site keeps its rules.
RULE_PATHS = ("/rules", "/rule", "/regulation", "/regulations", "/reglament", "/reglamento", "/regulations/", "/route", "/routes", "/faq", "/info", "/about")
CANDIDATES, RESULTS_IN_TEXT, PAGE_CHARS = 3, 5, 12_000


def merged_results(first: DataFrame, second: DataFrame, event: str = "event") -> DataFrame:
    """Results of two searches, each url once: where it came first. Results without a url go."""
    both = first.withColumn("_search", F.lit(1)).unionByName(second.withColumn("_search", F.lit(2))).filter(~blank(F.col("url")))
    once = first_by(both, [event, "url"], F.struct("_search", "rank"))
    place = F.row_number().over(Window.partitionBy(event).orderBy("_search", "rank", "url"))
    return once.withColumn("rank", place).drop("_search")


def candidates(results: DataFrame, event: str = "event", social: Sequence[str] = SOCIAL, listings: Sequence[str] = LISTINGS, trackers: Sequence[str] = TRACKERS, most: int = CANDIDATES) -> DataFrame:
    """event, the first urls that may be official (place, url), and the first tracker's url.

    Social networks and trackers are out; listings are, unless nothing else is left for the event.
    """
    d = domain(F.col("url"))
    kind = F.when(contains_any(d, social), "social").when(contains_any(d, trackers), "tracker").when(contains_any(d, listings), "listing").otherwise("site")
    rows = results.withColumn("kind", kind)
    every = Window.partitionBy(event)
    rows = rows.withColumns({
        "has_site": F.max((F.col("kind") == "site").cast("int")).over(every),
        "tracker_url": F.min(F.when(F.col("kind") == "tracker", F.struct("rank", "url"))).over(every).getField("url"),
    })
    open_ = rows.filter((F.col("kind") == "site") | ((F.col("kind") == "listing") & (F.col("has_site") == 0)))
    place = F.row_number().over(Window.partitionBy(event).orderBy("rank", "url"))
    chosen = open_.withColumn("place", place).filter(F.col("place") <= most).select(event, "place", "url")
    return rows.select(event, "tracker_url").distinct().join(chosen, event, "left")


def context_pages(official: DataFrame, pages: DataFrame, event: str = "event", paths: Sequence[str] = RULE_PATHS) -> DataFrame:
    """For each event's url the first of itself and its site's rule pages that has a text (url, text)."""
    urls = F.concat(F.array(F.col("url")), F.array(*[joined_url(base_site(F.col("url")), F.lit(p)) for p in paths]))
    tried = official.filter(F.col("url").isNotNull()).select(event, F.posexplode(urls).alias("_pos", "page_url"))
    text = pages.filter(~blank(F.col("text"))).select(F.col("url").alias("page_url"), F.substring(F.col("text"), 1, PAGE_CHARS).alias("text"))
    return first_by(tried.join(first_by(text, ["page_url"], F.col("text")), "page_url"), [event], F.col("_pos")).select(event, "page_url", "text")


def is_useful(context: Column, official_url: Column, tracker_url: Column, results: Column) -> Column:
    """Worth keeping: a filled field of the context, or an address or result to go on with."""
    filled = [context.getField(n) for n in ("summary", "surface", "route_character", "climate_notes", "resupply_notes")]
    told = F.coalesce(*[(x != "") & x.isNotNull() for x in filled[:1]], F.lit(False))
    for x in filled[1:]:
        told = told | F.coalesce(x != "", F.lit(False))
    told = told | (F.size(F.coalesce(context.getField("constraints"), F.array())) > 0) | context.getField("distance_km").isNotNull() | context.getField("total_climbing_m").isNotNull()
    known = lambda u: F.coalesce(u != "", F.lit(False))
    return F.coalesce(told, F.lit(False)) | known(official_url) | known(tracker_url) | (F.size(F.coalesce(results, F.array())) > 0)


def unproven(rows: DataFrame, pairs: Sequence[tuple[str, str]] = (("distance_km", "distance_evidence"), ("total_climbing_m", "climbing_evidence"))) -> DataFrame:
    """Rows with a number but not the evidence for it."""
    bad = F.lit(False)
    for number, evidence in pairs:
        bad = bad | (F.col(number).isNotNull() & F.col(evidence).isNull())
    return rows.filter(bad)


def context_text(context: Column, results: Column, official_url: Column, tracker_url: Column, with_results: bool = True) -> Column:
    """Context as lines, for retrieval: notes, the first results' titles and snippets, addresses."""
    notes = [context.getField(n) for n in ("summary", "surface", "route_character", "climate_notes", "resupply_notes")]
    parts = F.array(*notes, F.array_join(context.getField("constraints"), " "))
    if with_results:
        first = F.slice(F.coalesce(results, F.array()), 1, RESULTS_IN_TEXT)
        parts = F.concat(parts, F.flatten(F.transform(first, lambda r: F.array(r["title"], r["snippet"]))), F.array(official_url, tracker_url))
    return F.array_join(F.filter(F.transform(parts, strip), lambda p: p != ""), "\n")


def resolved(events: DataFrame, cache: DataFrame, fetched: DataFrame, now: float, ttl: float) -> DataFrame:
    """Each event's context: from the cache if that is fresh and useful, else as fetched.

    events has key; cache and fetched have key, created_at and the context's columns c, r, o, t.
    Adds from_cache; fetched rows that are useful are what goes into the cache next.
    """
    useful = is_useful(F.col("c"), F.col("o"), F.col("t"), F.col("r"))
    valid = (F.col("created_at") == 0) | (F.lit(now) - F.col("created_at") <= ttl)
    known = first_by(cache.filter(useful & valid), ["key"], -F.col("created_at"))
    hit = events.join(known, "key").withColumn("from_cache", F.lit(True))
    rest = events.join(known.select("key"), "key", "left_anti").join(first_by(fetched, ["key"], -F.col("created_at")), "key", "left")
    return hit.unionByName(rest.withColumn("from_cache", F.lit(False)))

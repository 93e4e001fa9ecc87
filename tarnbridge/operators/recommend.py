"""From ranked riders to a grounded recommendation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbridge.functions.text import blank, contains_any
from tarnbridge.operators.retrieval import mode

#: Fewer riders than this call for a second attempt; what a compact rider keeps.
FEW_RIDERS, TEXT_CHARS, KEY_ITEMS, CHUNKS = 3, 300, 5, 2
#: Words that show that a chunk tells of a component.
CHUNK_WORDS = {
    "tyres": ("tyre", "tyres", "tire", "tires", "tubeless", "casing", "mm"),
    "wheels": ("wheel", "wheels", "wheelset", "rim", "rims", "hub", "hubs", "650b", "700c", "29er", "27.5"),
    "drivetrain": ("drivetrain", "groupset", "cassette", "chainring", "gearing", "gear ratio", "sram", "shimano", "grx", "1x", "2x"),
    "bags": ("bag", "bags", "frame bag", "seat pack", "saddle bag", "top tube bag", "handlebar bag", "apidura", "tailfin", "ortlieb", "restrap"),
    "sleep_system": ("sleep", "sleeping bag", "bivy", "bivvy", "quilt", "mat", "pad", "tent"),
    "bike_type": ("gravel bike", "road bike", "endurance bike", "mountain bike", "mtb", "hardtail", "full suspension", "bike type", "frame"),
}


def two_attempts(first: DataFrame, second: DataFrame, asks: DataFrame) -> DataFrame:
    """Each query's riders from the first attempt, or from the second where that is better.

    first and second have query_id and hit (the rider shows the component asked for); asks has
    query_id and component. A second attempt is made without riders, with too few, or where a
    component is asked for and none shows it; it is adopted where the first has too few riders or
    it shows the component more often.
    """
    count = lambda rows, n: rows.groupBy("query_id").agg(F.count(F.lit(1)).alias(f"n{n}"), F.count_if("hit").alias(f"hits{n}"))
    c = asks.join(count(first, 1), "query_id", "left").join(count(second, 2), "query_id", "left").fillna(0, ["n1", "hits1", "n2", "hits2"])
    few = F.col("n1") < FEW_RIDERS
    tried = few | ((F.col("component") != "full_setup") & (F.col("hits1") == 0))
    chosen = c.select("query_id", F.when(tried & (few | (F.col("hits2") > F.col("hits1"))), 2).otherwise(1).alias("attempt"))
    both = first.withColumn("attempt", F.lit(1)).unionByName(second.withColumn("attempt", F.lit(2)))
    return both.join(chosen, ["query_id", "attempt"])


def intent_queries(broad: Column, question: Column, component: Column, phrases: dict[str, str]) -> tuple[Column, Column]:
    """The first and the second query: the component's before the broad one, if one is asked for."""
    phrase = F.coalesce(*[F.when(component == k, F.lit(v)) for k, v in phrases.items()], component)
    with_component = F.concat(broad, F.lit(". Focus: "), phrase)
    with_question = F.when(blank(question), broad).otherwise(F.concat(broad, F.lit(". Question focus: "), F.trim(question)))
    full = component == "full_setup"
    return F.when(full, broad).otherwise(with_component), F.when(full, with_question).otherwise(broad)


def filled_component(riders: DataFrame, structured: str, words: Sequence[str]) -> DataFrame:
    """query_id and value: the first structured field that isn't blank, else the first chunk with a word.

    riders has query_id, place, the field and chunks (array of texts).
    """
    chunk = F.try_element_at(F.filter("chunks", lambda c: contains_any(F.lower(c), words) & (F.trim(c) != "")), F.lit(1))
    field = F.when(~blank(F.col(structured)), F.trim(structured))
    return riders.groupBy("query_id").agg(F.min(F.when(field.isNotNull(), F.struct("place", field.alias("v")))).alias("_s"), F.min(F.when(chunk.isNotNull(), F.struct("place", F.trim(chunk).alias("v")))).alias("_c")).select(
        "query_id", F.coalesce(F.col("_s.v"), F.col("_c.v")).alias("value"))


def default_setup(riders: DataFrame, key: str, order: Column) -> DataFrame:
    """bike_type, wheels and tyres from the riders' most frequent fields; nothing is invented."""
    out = riders.select(key).distinct()
    for c in ("frame_type", "frame_material", "wheel_size", "tyre_width"):
        trimmed = riders.withColumn(c, F.trim(c))
        out = out.join(mode(trimmed, [key], c, order).select(key, c), key, "left")
    bike = F.concat_ws(" ", "frame_type", "frame_material")
    tyres = F.when(F.col("tyre_width").isNotNull() & F.col("wheel_size").isNotNull(), F.concat_ws(" on ", "tyre_width", "wheel_size")).otherwise(F.col("tyre_width"))
    return out.select(key, F.when(bike != "", bike).alias("bike_type"), F.col("wheel_size").alias("wheels"), tyres.alias("tyres"))


def postprocessed(riders: DataFrame, event: Column) -> DataFrame:
    """Adds year from the title where it is missing, and the final place: event's riders first, then score and year."""
    year = F.coalesce(F.col("year"), F.regexp_extract("event_title", r"((?:19|20)\d{2})", 1).try_cast("int"))
    same = F.lower(F.coalesce("event_title", F.lit(""))).contains(F.lower(event))
    order = Window.partitionBy("query_id").orderBy(F.desc(same), F.desc(F.coalesce("score", F.lit(0.0))), F.desc(F.coalesce("year", F.lit(0))), "pos")
    return riders.withColumn("year", year).withColumn("place", F.row_number().over(order))


def compact(text: Column, key_items: Column, chunks: Column) -> dict[str, Column]:
    """What a writer is given of a rider."""
    short = lambda x: F.substring(x, 1, TEXT_CHARS)
    return {"text": short(text), "key_items": F.slice(key_items, 1, KEY_ITEMS), "chunks": F.transform(F.slice(chunks, 1, CHUNKS), short)}


def source_text(fields: Sequence[Column], chunks: Column) -> Column:
    """Fields and chunk texts that aren't blank, in order, parted by bars."""
    return F.array_join(F.filter(F.concat(F.array(*fields), F.coalesce(chunks, F.array())), lambda x: F.trim(x) != ""), " | ")


def coverage(fields: Sequence[Column], key_items: Column) -> Column:
    """How many fields are filled, key items counting as one."""
    return sum(((~blank(x)).cast("int") for x in fields), F.lit(0)) + (F.size(F.coalesce(key_items, F.array())) > 0).cast("int")


def answer(event: Column, summary: Column, setup: dict[str, Column]) -> Column:
    """A recommendation as lines."""
    lines = [F.when(~blank(v), F.concat(F.lit(f"{k}: "), v)) for k, v in setup.items()]
    return F.concat_ws("\n", F.concat(F.lit("Event: "), event), summary, *lines)


def counters(rows: DataFrame, fields: Sequence[str], *by: str) -> DataFrame:
    """Mean coverage and, for each field, how many rows have it."""
    filled = [(~blank(F.col(c).cast("string"))).cast("int") for c in fields]
    return rows.groupBy(*by).agg(F.avg(sum(filled, F.lit(0))).alias("avg_coverage"), *[F.count_if(~blank(F.col(c).cast("string"))).alias(c) for c in fields])


def enough_evidence(rows: DataFrame, covered: str, least: int = 2, of: int = 2) -> DataFrame:
    """query_id and whether at least so many riders cover at least so many fields."""
    return rows.groupBy("query_id").agg((F.count_if(F.col(covered) >= of) >= least).alias("enough"))

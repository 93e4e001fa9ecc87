"""Events: finding them in queries by lexicon, similar ones, the scope of a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbridge.functions.text import title_exact, title_words
from tarnbridge.operators.lexicon import matches
from tarnbridge.sources.tables import small_side

#: Shares of a curated link, of the cosine and of the common words in a likeness.
SHARES = (0.5, 0.3, 0.2)
#: Enough exact owners for an exact scope, and how many similar events are used.
ENOUGH_EXACT = 4
MOST_SIMILAR = 4


def whole_alias(text: Column, alias: Column) -> Column:
    """The alias occurs between blanks or at an end of a normalised text."""
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), alias, F.lit(" ")))


def similar_events(pairs: DataFrame, most: int = MOST_SIMILAR) -> DataFrame:
    """Up to so many events like each event; pairs has event, other, title, curated, cosine, jaccard.

    Of others with the same title the best stays; a likeness of 0 is none.
    """
    a, b, c = SHARES
    scored = pairs.withColumn("score", a * F.col("curated").cast("double") + b * F.col("cosine") + c * F.col("jaccard")).filter("score > 0")
    once = Window.partitionBy("event", "title").orderBy(F.desc(F.round("score", 9)), "other")
    order = Window.partitionBy("event").orderBy(F.desc(F.round("score", 9)), "other")
    return scored.withColumn("_n", F.row_number().over(once)).filter("_n = 1").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("_n")


def scope(exact_owners: Column, similar: Column, enough: int = ENOUGH_EXACT) -> Column:
    """What a search is held to, from the counts of exact owners and of similar events.

    Too few exact owners are filled up even where no similar event is known.
    """
    return F.when(exact_owners >= enough, "exact_event").when(exact_owners > 0, "exact_plus_similar").when(similar > 0, "similar_events").otherwise("global")


def ground(queries: DataFrame, articles: DataFrame, owners: DataFrame, similar: DataFrame, enough: int = ENOUGH_EXACT) -> DataFrame:
    """What each query's search is held to: its event, the event's own articles, similar events, the scope.

    queries has query_id, query and hint (an event that keywords tell of, or null); articles has
    article_id and title; owners has article_id and owner_id; similar has event (a hint) and title,
    the events like it that are known, already cut to those to be used.

    Only articles with owners and a title count. The hint of a query is the longest title whose
    normal form occurs in the query's, else the one given. Exact articles are those whose title is
    the hint or has it as a run of whole words; where there are none, the given hint is tried. An
    event with too few owners gets similar events, too. Equally long titles go by the alphabet.

    Gives query_id, hint, exact_articles (sorted ids), exact_owners, needs_similar, similar_titles
    (sorted) and scope, a row a query. Queries without a hint search anywhere.
    """
    kept = articles.filter(F.trim("title") != "").join(owners.filter("owner_id is not null").select("article_id"), "article_id", "left_semi")
    kept = kept.select("article_id", "title", title_words(F.col("title")).alias("norm")).distinct()
    asked = queries.select("query_id", "hint", title_words(F.col("query")).alias("q"))
    names = kept.filter("norm <> ''").select("title", "norm").distinct()
    pick = F.min(F.struct((-F.length("title")).alias("l"), "title"))
    named = matches(asked, names, "q", "query_id", "norm").join(small_side(names.withColumnRenamed("norm", "alias")), "alias").groupBy("query_id").agg(pick.alias("n")).select("query_id", F.col("n.title").alias("from_title"))
    asked = asked.join(named, "query_id", "left").select("query_id", F.col("hint").alias("given"), F.coalesce("from_title", F.nullif("hint", F.lit(""))).alias("hint"))

    # a hint is looked up by its first word among the words of the titles
    wanted = asked.select(F.explode(F.array("hint", "given")).alias("h")).filter("h <> ''").distinct().withColumn("hn", title_words(F.col("h"))).filter("hn <> ''")
    words = kept.withColumn("w", F.explode(F.array_distinct(F.split("norm", " ")))).filter("w <> ''")
    found = wanted.withColumn("w", F.substring_index("hn", " ", 1)).join(words, "w").filter(title_exact(F.col("norm"), F.col("hn"))).select("h", "article_id").distinct()
    has = found.select("h").distinct().withColumn("known", F.lit(True))
    asked = asked.join(has.withColumnRenamed("h", "hint"), "hint", "left").withColumnRenamed("known", "own")
    asked = asked.join(has.withColumnRenamed("h", "given"), "given", "left")
    asked = asked.select("query_id", F.when(F.col("own").isNull() & F.col("known").isNotNull(), F.col("given")).otherwise(F.col("hint")).alias("hint"))

    exact = found.groupBy(F.col("h").alias("hint")).agg(F.array_sort(F.collect_set("article_id")).alias("exact_articles"))
    counts = found.join(owners, "article_id").groupBy(F.col("h").alias("hint")).agg(F.count_distinct("owner_id").alias("n"))
    like = similar.filter("event is not null").groupBy(F.col("event").alias("hint")).agg(F.array_sort(F.collect_set("title")).alias("titles"))
    out = asked.join(exact, "hint", "left").join(counts, "hint", "left").join(like, "hint", "left")
    n = F.coalesce("n", F.lit(0))
    needs = F.col("hint").isNotNull() & (n < enough)
    titles = F.when(needs, F.coalesce("titles", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    out = out.select("query_id", "hint", F.coalesce("exact_articles", F.array().cast("array<bigint>")).alias("exact_articles"), n.alias("exact_owners"), needs.alias("needs_similar"), titles.alias("similar_titles"))
    return out.withColumn("scope", scope(F.col("exact_owners"), F.size("similar_titles"), enough))


#: A family of events, what a title of the asked family adds, and what a title adds by the surface that is asked for and the first surface that it has.
FAMILY, FAMILY_BONUS = "granguanche", 0.08
SUBTYPES = {
    "road": (("road", 0.16), ("gravel", -0.04), ("trail", -0.08)),
    "gravel": (("gravel", 0.16), ("trail", 0.04), ("road", -0.05)),
    "trail": (("trail", 0.16), ("gravel", 0.04), ("road", -0.08)),
}


def subtype_bonus(title: Column, hint: Column, query: Column) -> Column:
    """What the surface and the family of an event's title add to a score; all three normalised by title_words()."""
    has = lambda c, w: F.concat(F.lit(" "), F.coalesce(c, F.lit("")), F.lit(" ")).contains(f" {w} ")
    first = lambda c, options: _first_case([(has(c, w), F.lit(x)) for w, x in options])
    bonus = F.when(has(title, FAMILY) & has(hint, FAMILY), FAMILY_BONUS).otherwise(0.0)
    return bonus + _first_case([(has(query, asked), first(title, options)) for asked, options in SUBTYPES.items()])


def _first_case(cases: list[tuple[Column, Column]]) -> Column:
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out.otherwise(0.0)


def is_known(title: Column) -> Column:
    """Whether an owner's event is named."""
    plain = F.lower(F.trim(title))
    return F.coalesce((plain != "") & (plain != "unknown event"), F.lit(False))

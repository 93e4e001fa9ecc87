"""Lexicons in texts: all aliases that occur in a text, in one pass over it.

The aliases make an Aho-Corasick automaton, built once and broadcast as bytes of a checked size. A task
follows it over its texts, a character a step, however many aliases there are, so time grows with the
length of the texts and the number of matches. A lexicon of more characters than an automaton may have
is split into several, and each text passes through each of them.

Matches are of characters as they are. ``whole`` asks for a blank or an end of the text on both sides,
as normalised texts have them. Overlapping matches, and aliases within aliases, all count. Null and empty
texts and aliases match nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbridge.sources.tables import small_side, spread

#: Characters of the aliases of one automaton; it has some fifty bytes for each.
AUTOMATON_CHARS = 1_000_000
#: Automata of a lexicon at most; what is larger is no lexicon but a table to be joined by its words.
MOST_AUTOMATA = 16


def automata(lexicon: DataFrame, alias: str = "alias", chars: int = AUTOMATON_CHARS) -> list[tuple[list[str], bytes]]:
    """The distinct aliases, and an automaton of them as bytes, for so many characters of aliases each.

    The size is checked before the aliases come to the driver; a lexicon that is too large is an error.
    """
    distinct = lexicon.select(F.col(alias).alias("alias")).filter("alias <> ''").distinct()
    size = distinct.agg(F.sum(F.length("alias"))).collect()[0][0] or 0
    if size > chars * MOST_AUTOMATA:
        raise ValueError(f"the lexicon has {size} characters; {chars * MOST_AUTOMATA} at most")
    parts: list[list[str]] = []
    count = chars
    for (name,) in distinct.sort("alias").collect() if size else ():
        if count + len(name) > chars:
            parts.append([])
            count = 0
        parts[-1].append(name)
        count += len(name)
    return [(names, _automaton(names)) for names in parts]


def _automaton(names: list[str]) -> bytes:
    automaton = ahocorasick.Automaton()
    for number, name in enumerate(names):
        automaton.add_word(name, number)
    automaton.make_automaton()
    return pickle.dumps((names, automaton))


def _in_text(text: str, names: list[str], automaton: ahocorasick.Automaton, whole: bool) -> dict[int, list[int]]:
    """By number of an alias: where it is first, and how often it is there."""
    found: dict[int, list[int]] = {}
    for last, number in automaton.iter(text):
        start = last + 1 - len(names[number])
        if whole and ((start and text[start - 1] != " ") or (last + 1 < len(text) and text[last + 1] != " ")):
            continue
        if number in found:
            found[number][1] += 1
        else:
            found[number] = [start, 1]
    return found


def matches(texts: DataFrame, lexicon: DataFrame, text: str = "text", key: str = "doc_id", alias: str = "alias", whole: bool = False, chars: int = AUTOMATON_CHARS) -> DataFrame:
    """key, alias, first (place of its first match, from 0) and times, a row for each row of texts and alias in it."""
    kind = texts.schema[key].dataType.simpleString()
    names = ["key", "alias", "first", "times"]
    schema = f"key {kind}, alias string, first bigint, times bigint"
    rows = spread(texts.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text <> ''"))
    out = None
    for _, made in automata(lexicon, alias, chars):
        shared = texts.sparkSession.sparkContext.broadcast(made)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            aliases, automaton = pickle.loads(shared.value)
            all_aliases = pa.array(aliases, pa.string())
            for batch in batches:
                row, number, first, times = [], [], [], []
                for i, value in enumerate(batch.column(1)):
                    found = _in_text(value.as_py(), aliases, automaton, whole)
                    row += [i] * len(found)
                    number += found
                    first += [at for at, _ in found.values()]
                    times += [n for _, n in found.values()]
                keys, hits = batch.column(0).take(pa.array(row, pa.int64())), all_aliases.take(pa.array(number, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, hits, pa.array(first, pa.int64()), pa.array(times, pa.int64())], names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = texts.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("key", key)


def first_in_lexicon(texts: DataFrame, lexicon: DataFrame, text: str = "text", longest: bool = False, whole: bool = False, key: str = "doc_id", chars: int = AUTOMATON_CHARS) -> DataFrame:
    """The rows of texts without the text, with key and alias of the entry of a lexicon (ord, key, alias) that occurs
    in each: the least ord, or the longest alias.

    Equally long aliases go by the alphabet, then by ord. Texts without an entry have nulls. An alias may be
    that of several entries.
    """
    entries = lexicon.filter("alias <> ''").select(F.col("ord").alias("_ord"), F.col("key").alias("_key"), F.col("alias").alias("_alias"))
    found = matches(texts.select(F.col(key).alias("_id"), F.col(text).alias("_text")), entries, "_text", "_id", "_alias", whole, chars).withColumnRenamed("alias", "_alias")
    pick = F.struct(-F.length("_alias"), "_alias", "_ord", "_key") if longest else F.struct("_ord", "_alias", "_key")
    best = found.join(small_side(entries), "_alias").groupBy("_id").agg(F.min(pick).alias("_best"))
    best = best.select(F.col("_id").alias(key), F.col("_best._key").alias("key"), F.col("_best._alias").alias("alias"))
    return texts.drop(text).join(best, key, "left")

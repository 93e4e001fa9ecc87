"""Traces and verdicts: the tools that a trace has called, a judge's answer as a record, reports."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbridge.functions.hashing import clamp
from tarnbridge.functions.text import json_inside, without_thoughts
from tarnbridge.operators.calls import WAITS, WINDOW, called, parted
from tarnbridge.session import shared_folder

MESSAGE = "array<struct<tool_name:string,name:string,tool:string,tool_calls:array<struct<function:struct<name:string>>>>>"
LEAST, MOST = 0, 6


def calls_in_messages(messages: Column) -> Column:
    """Distinct names of the tools called in messages, in order; messages as JSON, one or a list."""
    as_list = F.when(F.ltrim(messages).startswith("["), messages).otherwise(F.concat(F.lit("["), messages, F.lit("]")))
    filled = lambda c: F.when(c != "", c)
    named = lambda m: F.array(F.coalesce(filled(m["tool_name"]), filled(m["name"]), filled(m["tool"])))
    called = lambda m: F.transform(F.coalesce(m["tool_calls"], F.array()), lambda c: filled(c["function"]["name"]))
    each = F.transform(F.from_json(as_list, MESSAGE), lambda m: F.concat(named(m), called(m)))
    return F.array_distinct(F.array_compact(F.flatten(each)))


def calls_in_text(text: Column, names: Sequence[str]) -> Column:
    """The names that occur as whole words of a log, in the order of names."""
    return F.array_compact(F.array(*[F.when(text.rlike(rf"\b{n}\b"), F.lit(n)) for n in names]))


def used_any(calls: Column, names: Sequence[str]) -> Column:
    return F.arrays_overlap(calls, F.array(*map(F.lit, names)))


def verdict(raw: Column) -> dict[str, Column]:
    """score (0 to 6), notes and tags of a judge's answer; valid says whether it is an object.

    Thoughts and wrapping are taken off. The score goes by three names. Notes by criterion, sorted by
    name, are put below the notes. Tags may be a list or a text parted by commas.
    """
    text = json_inside(without_thoughts(raw))
    fields = F.from_json(text, "map<string,string>")
    number = lambda k: F.element_at(fields, k).try_cast("int")
    part = F.array_sort(F.filter(F.map_keys(fields), lambda k: k.startswith("notes_")))
    lines = F.filter(F.transform(part, lambda k: F.when(F.element_at(fields, k) != "", F.concat(F.lit("- "), F.replace(k, F.lit("notes_"), F.lit("")), F.lit(": "), F.element_at(fields, k)))), lambda x: x.isNotNull())
    base = F.coalesce(F.element_at(fields, "notes"), F.lit(""))
    notes = F.trim(F.array_join(F.array_compact(F.array(F.when(base != "", base), F.when(F.size(lines) > 0, F.array_join(lines, "\n")))), "\n"))
    tags = F.trim(F.element_at(fields, "tags"))
    listed = F.when(tags.startswith("["), F.from_json(tags, "array<string>")).otherwise(F.split(tags, ",", -1))
    clean = F.filter(F.transform(listed, lambda t: F.trim(t)), lambda t: t != "")
    score = F.coalesce(number("score_0_to_6"), number("score"), number("score_0_to_5"))
    return {"score": clamp(score, LEAST, MOST), "notes": F.coalesce(notes, F.lit("")), "tags": F.coalesce(clean, F.array().cast("array<string>")), "valid": F.coalesce(F.size(fields) > 0, F.lit(False))}


def report(rows: DataFrame, score: str, web: str, *by: str) -> DataFrame:
    """How many rows, their mean score and the percentage that used web tools; 0 where there are none."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), zero(F.avg(score)).alias("avg_score"), zero(100 * F.avg(F.col(web).cast("int"))).alias("pct_web"))


def judged(rows: DataFrame, prompt: Column, judge) -> DataFrame:
    """Adds the verdict of a judge, a function of a list of prompts that gives their raw answers.

    Answers that are no object are kept with valid = false, for a reject table.
    """
    @F.pandas_udf("string")
    def ask(x: pd.Series) -> pd.Series:
        return pd.Series(judge(x.tolist()), dtype=object)

    return rows.withColumn("raw", ask(prompt)).withColumns(verdict(F.col("raw")))


def judged_in_flight(rows: DataFrame, key: str, prompt: Column, judge, batch: int = 1, window: int = WINDOW, waits: Sequence[float] = WAITS) -> tuple[DataFrame, DataFrame]:
    """The key of each row with the verdict's columns, and the rejects: rows whose call failed, with the error.

    Calls of ``batch`` prompts are in flight together, ``window`` a worker, each tried again for itself. Each is made once: answers are kept in the shared folder.
    """
    shared_folder(rows.sparkSession)
    answers = called(rows.withColumn("_prompt", prompt), key, "_prompt", judge, "string", batch, window, waits).checkpoint()
    good, rejects = parted(answers)
    return good.withColumnRenamed("answer", "raw").withColumns(verdict(F.col("raw"))), rejects


def serialized(value: Column) -> Column:
    """A record or list as JSON, a text as it is."""
    return F.to_json(value)

"""Keeping tables in step: normalising records, upserts, merges and deletes without a transaction log.

Plain Parquet has no MERGE, so each operator gives the whole new table; the caller writes it beside
the old one and swaps the folders (sinks.swap).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbridge.functions.text import or_null, strip
from tarnbridge.sources.tables import parts_for


def first_by(rows: DataFrame, keys: Sequence[str | Column], *order: Column, last: bool = False) -> DataFrame:
    """One row a key: the first by order, or the last."""
    by = [(c.desc() if last else c.asc()) for c in order]
    w = Window.partitionBy(*keys).orderBy(*by)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def resolved(rows: DataFrame, candidates: Sequence[str], kind: str = "string") -> Column:
    """The first of some columns that the table has, else a null of the type."""
    found = next((c for c in candidates if c in rows.columns), None)
    return F.col(found).cast(kind) if found else F.lit(None).cast(kind)


def articles(rows: DataFrame) -> DataFrame:
    """title, url and body from any of the names that they go by; rows without a url are dropped."""
    pick = lambda *names: F.coalesce(*[F.nullif(resolved(rows, [n]), F.lit("")) for n in names])
    out = rows.withColumns({"_t": F.coalesce(pick("title", "article_title"), F.lit("Untitled")), "_u": pick("url", "article_url"), "_b": pick("body", "content", "text")})
    out = out.drop("title", "article_title", "url", "article_url", "body", "content", "text")
    return out.withColumnsRenamed({"_t": "title", "_u": "url", "_b": "body"}).filter("url is not null")


def riders(rows: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Columns by name from the first alias that isn't null; age is a number or null."""
    picked = {n: F.coalesce(*[F.col(a).cast("string") for a in names if a in rows.columns], F.lit(None).cast("string")) for n, names in aliases.items()}
    out = rows.select(*[c for c in rows.columns if c not in {a for names in aliases.values() for a in names}], *[c.alias(n) for n, c in picked.items()])
    return out.withColumn("age", strip(F.col("age")).try_cast("int")) if "age" in aliases else out


def rider_list(rows: DataFrame, names: Sequence[str] = ("riders", "rider_setups", "setups", "profiles", "people")) -> DataFrame:
    """A row for each record of the first list that is there."""
    lists = [F.col(n) for n in names if n in rows.columns]
    return rows.withColumn("rider", F.explode(F.coalesce(*lists))).drop(*names)


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], keep: Sequence[str] = (), stamp: dict[str, Column] | None = None) -> DataFrame:
    """Old rows, with new values where there are any, and new rows; columns in keep stay as they were.

    new has one row a key. stamp gives columns that an updated or inserted row gets.
    """
    k, values = list(key), [c for c in old.columns if c not in key]
    both = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), k, "full_outer")
    changed = F.col("_new").isNotNull()
    pick = lambda c: F.col(f"o.{c}") if c not in new.columns else F.when(changed & ~(F.lit(c in keep) & F.col("_old").isNotNull()), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    out = both.select(*k, *[pick(c).alias(c) for c in values], changed.alias("_changed"))
    for c, x in (stamp or {}).items():
        out = out.withColumn(c, F.when(F.col("_changed"), x).otherwise(F.col(c)))
    return out.drop("_changed")


def merge_existing_wins(old: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """Old rows and, of new rows with a key that isn't blank or known, the first."""
    fresh = first_by(new.filter(or_null(F.col(key)).isNotNull()), [key], order).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh)


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents that aren't gone, and the children of those.

    All are dealt out by their key into parts for the children's rows and meet there in order: nothing is broadcast.
    """
    parts = parts_for(children)
    parents, gone = parents.repartition(parts, parent_key), gone.repartition(parts, parent_key)
    left = parents.join(gone.hint("merge"), parent_key, "left_anti")
    return left, children.repartition(parts, child_key).join(left.select(F.col(parent_key).alias(child_key)).hint("merge"), child_key, "left_semi")


def unnamed_once(rows: DataFrame, keys: Sequence[str], name: str, order: Column) -> DataFrame:
    """One row for each trimmed, lower-case name within the keys; rows without a name are one."""
    return first_by(rows, [*map(F.col, keys), F.lower(strip(F.coalesce(F.col(name), F.lit(""))))], order)


def latest_valid(log: DataFrame, key: str, valid: Column, order: Column) -> DataFrame:
    """The last valid row of each key of an append-only log."""
    return first_by(log.filter(F.col(key).isNotNull() & valid), [key], order, last=True)


def not_done(rows: DataFrame, done: DataFrame, key: str, also: str, order: Column) -> DataFrame:
    """Rows whose key and second key (such as an answer's hash) are not done yet, first of equals."""
    left = rows.join(done.select(key), key, "left_anti").join(done.select(also), also, "left_anti")
    return first_by(first_by(left, [key], order), [also], order)


def by_priority(rows: DataFrame, *sources: tuple[DataFrame, str, Column], fallback: Column, order: str = "pos") -> DataFrame:
    """Adds truth and found_by: the first source (a value by key) that knows a row, else the fallback.

    Of a key that a source has several times the last by its column order counts (the greatest
    value where it has no such column), so a row stays one row.
    """
    names = []
    for i, (source, value, key) in enumerate(sources):
        names.append(f"_truth_{i}")
        last = F.max_by(value, order) if order in source.columns else F.max(value)
        right = source.filter(F.col("key").isNotNull() & F.col(value).isNotNull()).groupBy(F.col("key").alias(f"_key_{i}")).agg(last.alias(names[-1]))
        rows = rows.join(right, key == F.col(f"_key_{i}"), "left").drop(f"_key_{i}")
    by = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(i + 1)) for i, n in enumerate(names)], F.lit(0))
    return rows.withColumns({"truth": F.coalesce(*map(F.col, names), fallback), "found_by": by}).drop(*names)

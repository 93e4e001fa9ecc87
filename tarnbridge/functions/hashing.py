"""Stable keys and small numeric helpers over columns."""

from __future__ import annotations

import hashlib
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip


def content_hash(title: Column, body: Column) -> Column:
    return F.sha2(F.concat(strip(F.coalesce(title, F.lit(""))), F.lit("\n"), strip(F.coalesce(body, F.lit("")))), 256)


def answer_hash(text: Column) -> Column:
    return F.sha2(strip(text), 256)


def cache_key(*parts: Column) -> Column:
    """16 hexadecimal digits of the trimmed, lower-case parts."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.lower(strip(F.coalesce(p.cast("string"), F.lit("")))) for p in parts]), 256), 1, 16)


def stable_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, 12))


@F.pandas_udf(T.DecimalType(20, 0))
def point_id(text: pd.Series) -> pd.Series:
    """Unsigned 64-bit BLAKE2b of a string; no built-in function has this hash."""
    return text.map(lambda s: None if s is None else Decimal(int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big")))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def int_or_null(x: Column) -> Column:
    return strip(x).try_cast("int")


def first_filled(*items: Column) -> Column:
    """The first value that isn't blank."""
    return F.coalesce(*[F.when(strip(x) != "", x) for x in items])


def fresh(created_at: Column, now: float, ttl: float) -> Column:
    """Within its time to live; a time of 0 never expires."""
    return (created_at == 0) | (F.lit(now) - created_at <= ttl)


def overlaps(low_1: Column, high_1: Column, low_2: Column, high_2: Column) -> Column:
    """Ranges with open ends meet; a range without both ends meets everything."""
    unknown = (low_1.isNull() & high_1.isNull()) | (low_2.isNull() & high_2.isNull())
    apart = (F.coalesce(high_1, F.lit(1e9)) < F.coalesce(low_2, F.lit(-1e9))) | (F.coalesce(high_2, F.lit(1e9)) < F.coalesce(low_1, F.lit(-1e9)))
    return unknown | ~apart

"""String functions over columns. Blank means empty or white space only, Unicode included."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines of a page's menu, the start of its tail, and the labels of an article.
MENU_LINES = ("DotWatcher.cc", "Event Commentary", "Results", "Event Calendar", "Features", "About Us")
TAIL_MARK = "Also from"
PHRASE_BREAKS = r"(?:\n+|•|- |\t|;|,|\|)+"
MAX_CHUNK = 280
TRUE_WORDS = ("yes", "y", "true", "sí", "si")
FALSE_WORDS = ("no", "n", "false")
#: What marks a line of a log as the trace of a web tool, and an address in it.
WEB_LOG = r"(?i)(http request:|primp:|duckduckgo|wikipedia\.org|yandex\.com|brave\.com|ddgs|opensearch|GET\s+https?://|POST\s+https?://)"
ADDRESS = r"(?i)https?://\S+|www\.\S+"
LEAST_REMARK = 25


def strip(x: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank(x: Column) -> Column:
    return x.isNull() | (strip(x) == "")


def or_null(x: Column) -> Column:
    """Null instead of a blank string."""
    return F.when(~blank(x), x)


def squeezed(x: Column) -> Column:
    """Lower case, words one blank apart."""
    return strip(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)\s+", " "))


def contains_any(x: Column, terms: Sequence[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | x.contains(term)
    return found


def count_of(x: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur."""
    return sum((x.contains(t).cast("int") for t in terms), F.lit(0))


# labels and lines of articles


def label(line: Column) -> Column:
    """A line as a label: no trailing colon, no leading "your", lower case."""
    x = strip(F.regexp_replace(strip(line), r":$", ""))
    return F.lower(F.when(F.lower(x).startswith("your "), strip(F.substring(x, 6, 1_000_000))).otherwise(x))


def is_date_line(line: Column) -> Column:
    return line.rlike(r"(?U)^\d{1,2}\s+\w+,\s+\d{4}$")


def is_age_label(line: Column) -> Column:
    return label(line) == "age"


def clean_body(body: Column, menu: Sequence[str] = MENU_LINES, tail: str = TAIL_MARK) -> Column:
    """Without the menu lines and blank lines at the top and everything from the tail mark on."""
    lines = F.split(body, r"\r\n|\n|\r", -1)
    kept = F.transform(F.array(lines), lambda ls: F.slice(ls, F.coalesce(F.array_min(F.filter(
        F.transform(ls, lambda x, i: F.when(~(blank(x) | strip(x).isin(*menu)), i + 1)), lambda i: i.isNotNull())), F.size(ls) + 1), F.greatest(F.size(ls), F.lit(1)))).getItem(0)
    text = F.array_join(kept, "\n")
    return F.when(text.contains(tail), F.regexp_replace(F.substring_index(text, tail, 1), r"(?U)\s+$", "")).otherwise(text)


def clean_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, "(?i)bikes of", ""))


def age(raw: Column) -> Column:
    """Leading one to three digits between 1 and 120, as a string."""
    n = F.regexp_extract(strip(raw), r"^(\d{1,3})", 1).try_cast("int")
    return F.when((n > 0) & (n <= 120), n.cast("string"))


def yes_no(raw: Column) -> Column:
    x = F.lower(strip(raw))
    return F.when(x.isin(*TRUE_WORDS), True).when(x.isin(*FALSE_WORDS), False)


# phrases and chunks


def distinct_ci(items: Column) -> Column:
    """Distinct regardless of case; the first of each stays, in order."""
    lowered = F.transform(items, F.lower)
    return F.transform(F.array(lowered), lambda low: F.filter(items, lambda x, i: F.array_position(low, F.get(low, i)) == i + 1)).getItem(0)


def phrases(text: Column) -> Column:
    """Short phrases of a free-text list."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), PHRASE_BREAKS, -1), strip), lambda p: p != "")
    return distinct_ci(parts)


def list_items(text: Column) -> Column:
    """Items parted by a bar or comma."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[|,]", -1), strip), lambda p: p != "")


def packed(items: Column, most: int = MAX_CHUNK) -> Column:
    """Items joined by "; " into strings of at most so many characters; a longer item stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))
    fits = lambda a, p: F.length(a["open"]) + 2 + F.length(p) <= most

    def step(a: Column, p: Column) -> Column:
        full = F.struct(F.array_append(a["done"], a["open"]).alias("done"), p.alias("open"))
        more = F.struct(a["done"].alias("done"), F.concat(a["open"], F.lit("; "), p).alias("open"))
        return F.when(a["open"].isNull(), F.struct(a["done"].alias("done"), p.alias("open"))).when(fits(a, p), more).otherwise(full)

    return F.aggregate(items, start, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["open"])))


def rough_tokens(text: Column) -> Column:
    """About four characters a token, one at least; 0 for a blank text."""
    n = F.length(strip(text))
    return F.when(text.isNull() | (n == 0), 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("bigint")


def python_bool(x: Column) -> Column:
    return F.when(x, "True").when(~x, "False")


def labelled(pairs: Sequence[tuple[str, Column]], between: str, inside: str = "=") -> Column:
    """``name=value`` of all values that aren't blank."""
    return F.concat_ws(between, *[F.when(~blank(v), F.concat(F.lit(f"{k}{inside}"), strip(v))) for k, v in pairs])


# titles


@F.pandas_udf(T.StringType())
def without_accents(x: pd.Series) -> pd.Series:
    """Compatibility-decomposed, without combining marks. No built-in function does this."""
    import unicodedata

    return x.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def letters_and_digits(x: pd.Series) -> pd.Series:
    """Lower case, decomposed, without marks and anything but letters, digits and white space."""
    import unicodedata

    def one(s):
        if s is None:
            return None
        t = (c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn")
        return " ".join("".join(c for c in t if c.isalnum() or c.isspace()).split())

    return x.map(one)


def title_words(title: Column) -> Column:
    """A title for matching: no accents, years, apostrophes or punctuation, in lower case."""
    x = F.lower(without_accents(F.coalesce(title, F.lit(""))))
    x = F.regexp_replace(x, r"\b(?:19|20)\d{2}\b", " ")
    x = F.regexp_replace(x, r"['’`]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9]+", " "), " +", " "))


def letters_key(text: Column) -> Column:
    """Text that is equal to others but for case and accents; for joins, groups and comparisons, not to be shown.

    The comparison is the collation's, inside the JVM: unlike without_accents it takes a sharp s for two of them. Null stays null.
    """
    return F.collate(text, "UNICODE_CI_AI")


def title_key(title: Column) -> Column:
    """A key under which titles are equal but for accents, case, years, apostrophes and punctuation.

    As title_words, without a Python worker; letters of all scripts count, where title_words keeps a to z only. Null is as empty.
    """
    inside = r"[\p{L}\p{M}\p{N}_]"
    x = F.regexp_replace(F.coalesce(title, F.lit("")), rf"(?<!{inside})(?:19|20)\d{{2}}(?!{inside})", " ")
    x = F.regexp_replace(x, r"['’`]", "")
    return letters_key(F.trim(F.regexp_replace(x, r"[^\p{L}\p{M}\p{N}]+", " ")))


def tokens(words: Column) -> Column:
    return F.array_distinct(F.filter(F.split(words, " ", -1), lambda t: t != ""))


def titles_match(a: Column, b: Column) -> Column:
    """Fuzzy: equal, equal or nested word sets, or one inside the other; on title_words."""
    x, y = tokens(a), tokens(b)
    nested = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return (a != "") & (b != "") & ((a == b) | nested | a.contains(b) | b.contains(a))


def title_exact(title: Column, event: Column) -> Column:
    """Equal, or the event is a run of whole words of the title; on title_words."""
    return (title != "") & (event != "") & F.concat(F.lit(" "), title, F.lit(" ")).contains(F.concat(F.lit(" "), event, F.lit(" ")))


def token_jaccard(a: Column, b: Column) -> Column:
    """Share of common words; 0 if either has none."""
    x, y = tokens(a), tokens(b)
    both = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / both)


# addresses, logs, names


def canonical_url(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def domain(url: Column) -> Column:
    return F.lower(F.substring_index(F.regexp_replace(url, r"^https?://", ""), "/", 1))


def base_site(url: Column) -> Column:
    found = F.regexp_extract(url, r"^(https?://[^/]+)", 1)
    return F.when(found != "", found).otherwise(url)


def joined_url(base: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))


def redacted(text: Column) -> Column:
    """A log without the lines of web tools, and without addresses in the lines that remain."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r", -1), lambda x: ~x.rlike(WEB_LOG))
    remark = lambda x: F.regexp_replace(F.regexp_replace(x, ADDRESS, ""), r"^[ \-:\t]+|[ \-:\t]+$", "")
    lines = F.filter(lines, lambda x: ~x.rlike(ADDRESS) | (F.length(remark(x)) >= LEAST_REMARK))
    joined = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, ADDRESS, "[url removed]")), "\n")
    return strip(F.regexp_replace(joined, r"\n{3,}", "\n\n"))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def without_year(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s*\b20\d{2}\b\s*", " "))


def year_in(x: Column, pattern: str = r"((?:19|20)\d{2})", default: int | None = None) -> Column:
    found = F.regexp_extract(x, pattern, 1).try_cast("int")
    return F.coalesce(found, F.lit(default).cast("int"))


def normal_question(x: Column) -> Column:
    return F.translate(squeezed(x), "’–—", "'--")


def masked_dsn(dsn: Column) -> Column:
    """A connection string without its password."""
    return F.regexp_replace(dsn, r"(://[^:/@]+:)[^@]+@", "$1***@")


def clipped(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


def without_thoughts(x: Column) -> Column:
    return F.regexp_replace(x, r"(?is)<think>.*?</think>", "")


def json_inside(x: Column) -> Column:
    """The outermost braces of a text, also of a result printed as output='...'."""
    inner = F.regexp_extract(x, r"(?s)output='(.*?)'\)", 1)
    text = F.when(inner != "", F.replace(inner, F.lit("\\n"), F.lit("\n"))).otherwise(x)
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)

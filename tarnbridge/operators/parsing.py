"""Articles: links and text of pages, riders' records in free text, JSON objects in a row."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnbridge.functions.text import FALSE_WORDS, TRUE_WORDS

#: The labels of a rider's record by the field that they fill.
FIELDS = {
    "age": "age", "location": "location", "bike": "bike", "frame type": "frame_type", "frame material": "frame_material",
    "wheel size": "wheel_size", "tyre width": "tyre_width", "electronic shifting": "electronic_shifting",
}
ITEMS, SKIPPED, TITLE_START = "key items of kit", "cap number", "Bikes of "
_DATE = re.compile(r"^\d{1,2}\s+\w+,\s+\d{4}$")

RIDER = T.StructType([T.StructField(n, T.BooleanType() if n == "electronic_shifting" else T.StringType()) for n in ("name", *FIELDS.values(), "key_items")])


def _label(line: str) -> str:
    x = line.strip()
    x = x[:-1].strip() if x.endswith(":") else x
    return (x[5:].strip() if x.lower().startswith("your ") else x).lower()


def _boundary(line: str) -> bool:
    return _label(line) in FIELDS or _label(line) in (ITEMS, SKIPPED) or line.startswith(TITLE_START) or bool(_DATE.match(line))


def _value(line: str) -> str:
    return line.strip().lstrip(":").strip()


def parse_riders(body: str | None) -> list[dict]:
    """The riders' records of an article's text.

    Each line that says Age begins a record, up to the next; the name is the nearest line before it
    that is neither label, date nor title. A label takes the line after it as its value, whatever it
    is. Key items take the first line after their label and those up to the next label.
    """
    lines = [x.strip() for x in (body or "").splitlines() if x.strip()]
    starts = [i for i, x in enumerate(lines) if _label(x) == "age"]
    out = []
    for start, end in zip(starts, [*starts[1:], len(lines)], strict=False):
        record: dict = dict.fromkeys(RIDER.names)
        record["name"] = next((lines[j] for j in range(start - 1, -1, -1) if not _boundary(lines[j])), None)
        i = start + 1
        if i < len(lines) and re.fullmatch(r"\d{1,3}", _value(lines[i])):
            record["age"] = _value(lines[i]) if 0 < int(_value(lines[i])) <= 120 else None
            i += 1
        while i < end:
            label = _label(lines[i])
            if label == SKIPPED:
                i += 2
            elif label == ITEMS:
                items, i = lines[i + 1 : i + 2], i + 2
                while i < end and not _boundary(lines[i]):
                    items.append(lines[i])
                    i += 1
                record["key_items"] = "\n".join(items) or None
            elif label in FIELDS and i + 1 < len(lines):
                value, field = _value(lines[i + 1]), FIELDS[label]
                if value and field == "electronic_shifting":
                    record[field] = True if value.lower() in TRUE_WORDS else False if value.lower() in FALSE_WORDS else None
                elif value:
                    record[field] = value
                i += 2
            else:
                i += 1
        out.append(record)
    return out


@F.pandas_udf(T.ArrayType(RIDER))
def riders_of(body: pd.Series) -> pd.Series:
    return body.map(parse_riders)


class _Text(HTMLParser):
    """The texts of a page's nodes, each with the elements it is in: the first of a tag by its name, others as name and number."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.texts: list[tuple[str, frozenset]] = []
        self.seen: Counter[str] = Counter()

    def handle_starttag(self, tag, attrs):
        self.seen[tag] += 1
        if tag not in ("br", "img", "hr", "input", "meta", "link"):
            self.open.append((tag, tag if self.seen[tag] == 1 else f"{tag} {self.seen[tag]}"))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        inside = frozenset(x for names in self.open for x in names if x == names[1] or x in ("script", "style"))
        if data.strip() and not inside & {"script", "style"}:
            self.texts.append((data.strip(), inside))


ARTICLE = T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType()), T.StructField("page_text", T.StringType())])


def parse_article(html: str | None) -> tuple[str, str, str]:
    """Title (the first first-level heading, its parts joined), text of the first article element, text of the first main, else body, else all."""
    page = _Text()
    page.feed(html or "")
    page.close()
    part = lambda tag: [t for t, inside in page.texts if tag in inside]
    best = next((tag for tag in ("main", "body") if tag in page.seen), None)
    return "".join(part("h1")), "\n".join(part("article")), "\n".join(part(best) if best else [t for t, _ in page.texts])


@F.pandas_udf(ARTICLE)
def article_of(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_article(x) for x in html], columns=ARTICLE.names)


class _Links(HTMLParser):
    """Targets of the links of a page, in page order."""

    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            target = next((v for n, v in attrs if n == "href"), None)
            if target:
                self.found.append(target)


@F.pandas_udf(T.ArrayType(T.StringType()))
def links_of(html: pd.Series) -> pd.Series:
    """Targets of the links of each page, whatever the order and quoting of the attributes."""

    def links(page: str | None) -> list[str]:
        parser = _Links()
        parser.feed(page or "")
        parser.close()
        return parser.found

    return html.map(links)


def json_objects(text: str) -> Iterator[str]:
    """Objects that follow each other in a text, by the depth of braces outside strings."""
    depth, start, quoted, escaped = 0, -1, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = (quoted and not (c == '"' and not escaped)), (c == "\\" and not escaped)
        elif c == '"':
            quoted = depth > 0
        elif c == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                yield text[start : i + 1]
    if depth:
        raise ValueError("the text ends within an object")


def read_objects(files: DataFrame, schema: str) -> DataFrame:
    """A row for each JSON object of whole texts (column value), in any layout."""

    def split(batches):
        for pdf in batches:
            yield pd.DataFrame({"pos": [i for t in pdf["value"] for i, _ in enumerate(json_objects(t))], "json": [json.dumps(json.loads(o)) for t in pdf["value"] for o in json_objects(t)]})

    rows = files.select("value").mapInPandas(split, "pos int, json string")
    return rows.select("pos", F.from_json("json", schema).alias("_o")).select("pos", "_o.*")

"""Markup and sheets as columns: a page's lines, links and meta fields, rows of its tables, sitemap addresses, schedule sheets."""

from __future__ import annotations

import csv
import html
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags that begin a line, and tags whose content isn't text.
BLOCKS = {"p", "div", "li", "tr", "td", "th", "br", "h1", "h2", "h3", "h4"}
HIDDEN = {"script", "style", "svg"}
PIECE = re.compile(r"<!--.*?(?:-->|$)|<([/!?]?)([a-zA-Z][^\s/>]*)?((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

LINK = T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])
PAGE = T.StructType([T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(LINK)), T.StructField("meta", T.MapType(T.StringType(), T.StringType()))])


def spaced(value: str) -> str:
    return " ".join(value.split())


def events(markup: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, attributes), ("close", tag, "") and ("text", "", words) in order, without what stands in hidden elements."""
    hidden = ""
    for m in PIECE.finditer(markup):
        sign, tag, rest, words = m.groups()
        tag = (tag or "").lower()
        if hidden:
            if sign == "/" and tag == hidden:
                hidden = ""
        elif words is not None:
            yield "text", "", html.unescape(words)
        elif sign == "" and tag in HIDDEN:
            hidden = "" if (rest or "").rstrip().endswith("/") else tag
        elif tag and sign in ("", "/"):
            yield ("close" if sign else "open"), tag, rest or ""


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(next(filter(None, values), "")))
    return out


def parse(markup: str) -> tuple[str, list[tuple[str, str]], dict[str, str]]:
    """Lines of text, links with their text, and meta fields by lower-case property or name (the last of equal ones)."""
    words: list[str] = []
    links: list[tuple[str, str]] = []
    meta: dict[str, str] = {}
    href, start = "", 0
    for kind, tag, value in events(markup):
        if kind == "text":
            words.append(value)
            continue
        if tag in BLOCKS:
            words.append("\n")
        if tag == "a" and kind == "open":
            href, start = attributes(value).get("href", ""), len(words)
        elif tag == "a" and href:
            links.append((href, spaced("".join(words[start:]))))
            href = ""
        elif tag == "meta" and kind == "open":
            own = attributes(value)
            name = own.get("property") or own.get("name")
            if name and own.get("content"):
                meta[name.lower()] = own["content"]
    lines = map(spaced, "".join(words).splitlines())
    return "\n".join(filter(None, lines)), links, meta


def table_rows(markup: str) -> list[list[str]]:
    """The cells of all rows of all tables, rows without a word left out."""
    rows: list[list[str]] = []
    row: list[str] | None = None
    cell: list[str] | None = None
    for kind, tag, value in events(markup):
        if kind == "text":
            if cell is not None:
                cell.append(value)
        elif tag == "br" and cell is not None:
            cell.append(" ")
        elif tag == "tr":
            if kind == "close" and row and any(row):
                rows.append(row)
            row, cell = ([] if kind == "open" else None), None
        elif tag in ("td", "th") and row is not None:
            if kind == "open":
                cell = []
            elif cell is not None:
                row.append(spaced("".join(cell)))
                cell = None
    return rows


def sheet_rows(sheet: str, year: int) -> list[list[str]]:
    """Date, two titles and number of a schedule sheet; month/day dates get the year. A sheet without its heading is an error."""
    rows = [r for r in csv.reader(io.StringIO(sheet)) if len(r) >= 4]
    if all(r[0].strip() != "上市日" for r in rows):
        raise ValueError("the sheet has no 上市日 column")
    out = []
    for first, *rest in rows:
        day = re.sub(r"^(\d{1,2})/(\d{1,2})$", lambda m: f"{year}/{int(m[1]):02}/{int(m[2]):02}", first.strip())
        if re.fullmatch(r"20\d{2}/\d{1,2}/\d{1,2}", day):
            out.append([day, *(c.strip() for c in rest[:3])])
    return out


def _each(fn, kind: T.DataType):
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else fn(v))

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


@F.pandas_udf(PAGE)
def page(markup: pd.Series) -> pd.DataFrame:
    """text, links and meta of a page; a null page is an empty one."""
    rows = [parse(m or "") for m in markup]
    return pd.DataFrame({"text": [r[0] for r in rows], "links": [[{"href": h, "text": t} for h, t in r[1]] for r in rows], "meta": [r[2] for r in rows]})


tables = _each(table_rows, T.ArrayType(T.ArrayType(T.StringType())))


def schedule(sheet: Column, year: int) -> Column:
    """The rows of a sheet; null where it is none."""

    def read(value: str) -> list[list[str]] | None:
        try:
            return sheet_rows(value, year)
        except ValueError:
            return None

    return _each(read, T.ArrayType(T.ArrayType(T.StringType())))(sheet)


def sheet_tabs(markup: Column) -> Column:
    """year * 100 + month and gid of the sheet's tabs, latest first; years before 1911 count from it."""
    found = F.regexp_extract_all(markup, F.lit(r'items\.push\(\{name:\s*"(\d{5,6}\s*[（(]動漫[）)]\s*".*?gid:\s*"\d+)"'), F.lit(1))
    number = lambda x: F.regexp_extract(x, r"^(\d+)", 1).cast("int")
    months = F.transform(found, lambda x: F.struct(F.when(number(x) < 191100, number(x) + 191100).otherwise(number(x)).alias("month"), F.regexp_extract(x, r'gid:\s*"(\d+)$', 1).alias("gid")))
    return F.sort_array(F.array_distinct(F.filter(months, lambda x: (x["month"] % 100).between(1, 12))), asc=False)


def near_months(tabs: Column, today: Column, reach: int = 2) -> Column:
    """The tabs at most reach months from today."""
    count = lambda m: F.floor(m / 100) * 12 + m % 100
    now = F.year(today) * 12 + F.month(today)
    return F.filter(tabs, lambda x: F.abs(count(x["month"]) - now) <= reach)


def sitemap(xml: Column) -> Column:
    """The addresses of a sitemap."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))

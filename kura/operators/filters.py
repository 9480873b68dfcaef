"""Predicates over catalog rows; each returns a Column."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

RESTRICTED = "restricted_18"
MODES = ("general", "bl", "r18", "all")
FILTERS = ("general", "bl", "r18", "bl_r18")


def _is_restricted(rating: Column) -> Column:
    return F.coalesce(rating, F.lit("unknown")) == RESTRICTED


def _is_bl(bl: Column) -> Column:
    return F.coalesce(bl, F.lit("")) != ""


def visible(mode: str, rating: Column, bl: Column) -> Column:
    """What a reader of a mode may see; a null rating is unknown, a null or empty category is none."""
    if mode not in MODES:
        raise ValueError(mode)
    tests = [] if mode in ("r18", "all") else [~_is_restricted(rating)]
    tests += [] if mode in ("bl", "all") else [~_is_bl(bl)]
    return reduce(and_, tests, F.lit(True))


def visible_for(mode: Column, rating: Column, bl: Column) -> Column:
    """visible(), with a mode from each row."""
    return (mode.isin("r18", "all") | ~_is_restricted(rating)) & (mode.isin("bl", "all") | ~_is_bl(bl))


def audience(preference: Column, legacy: Column, role: Column) -> Column:
    """A recipient's mode: the preference, else the older flag, else what the role has."""
    return F.coalesce(preference, F.when(legacy == 1, "all").when(legacy == 0, "general"), F.when(role == "admin", "all").otherwise("general"))


def content(chosen: str, rating: Column, bl: Column) -> Column:
    """Any of the comma-separated kinds; '' is all, 'none' nothing."""
    kinds = [k for k in chosen.split(",") if k]
    if kinds == ["none"]:
        return F.lit(False)
    if len(set(kinds)) != len(kinds) or not set(kinds) <= set(FILTERS):
        raise ValueError(chosen)
    r, b = _is_restricted(rating), _is_bl(bl)
    tests = {"general": ~r & ~b, "bl": b, "r18": r, "bl_r18": b & r}
    return reduce(or_, [tests[k] for k in kinds], F.lit(False)) if kinds else F.lit(True)


def one_of(chosen: str, code: Column, most: int = 32) -> Column:
    """A multi-select of codes; '' is all, 'none' nothing."""
    codes = list(dict.fromkeys(c for c in chosen.split(",") if c))
    if codes == ["none"]:
        return F.lit(False)
    if len(codes) > most:
        raise ValueError("too many codes")
    return code.isin(*codes) if codes else F.lit(True)


def search(query: str, columns: list[Column], most: int = 8) -> Column:
    """Every one of the first terms is in some column, whatever the case."""
    terms = query.casefold().split()[:most]
    folded = [F.lower(F.coalesce(c, F.lit(""))) for c in columns]
    return reduce(and_, [reduce(or_, [F.contains(c, F.lit(t)) for c in folded]) for t in terms], F.lit(True))


def relevance(query: str, title: Column, series: Column) -> list[Column]:
    """Sort keys: whole title, then prefix, then whole series."""
    q = " ".join(query.casefold().split())
    return [(F.lower(title) == q).cast("int").desc(), F.startswith(F.lower(title), F.lit(q)).cast("int").desc(), (F.lower(series) == q).cast("int").desc()]


CODE = "[A-Za-z0-9_-]{1,64}"


def publishers(chosen: str, single: str, code: Column) -> Column:
    """The multi-select where it is given, else the one code; codes are checked by form."""
    chosen = chosen or single
    if chosen != "none" and not all(re.fullmatch(CODE, c) for c in chosen.split(",") if c):
        raise ValueError(chosen)
    return one_of(chosen, code)


def status(chosen: str, column: Column, date: Column) -> Column:
    """A release status; scheduled_undated is scheduled without a date."""
    if chosen == "scheduled_undated":
        return (column == "scheduled") & date.isNull()
    return column == chosen if chosen else F.lit(True)


def owned_format(chosen: str, column: Column) -> Column:
    if chosen not in ("", "paper", "digital", "both"):
        raise ValueError(chosen)
    return column == chosen if chosen else F.lit(True)


def terms(query: str, most: int = 8) -> list[str]:
    """The first terms of a query, normalised and folded."""
    return " ".join(unicodedata.normalize("NFKC", query).split()).casefold().split()[:most]


def search_any_accent(query: str, columns: list[Column], isbn: Column | None = None) -> Column:
    """Every term is in some column, whatever the case, accent or width. In the ISBN a term is sought without its hyphens where
    nothing but letters and digits is left of it."""
    found = []
    for term in terms(query):
        own = [F.contains(F.collate(F.coalesce(c, F.lit("")), "UNICODE_CI_AI"), F.collate(F.lit(term), "UNICODE_CI_AI")) for c in columns]
        bare = term.replace("-", "")
        if isbn is not None:
            own.append(F.contains(F.lower(F.coalesce(isbn, F.lit(""))), F.lit(bare if bare.isalnum() else term)))
        found.append(reduce(or_, own))
    return reduce(and_, found, F.lit(True))


def trusted_general(rating: Column, confidence: Column, source: Column, locked: Column, checked: Column, version: Column, code: Column, versions: dict[str, str]) -> Column:
    """A proven general rating: by the publisher's page with that publisher's own parser version, or locked by hand. Null proves nothing."""
    own = F.try_element_at(F.create_map(*[F.lit(x) for pair in versions.items() for x in pair]), code)
    page = (source == "publisher") & checked.isNotNull() & (version == own)
    return F.coalesce((rating == "general") & (confidence == 100) & (page | (source == "manual") & locked), F.lit(False))


def missing(kind: str, column: Column, since: str = "2010-01-01") -> Column:
    """Quality tests for an absent text, an absent date, or a suspicious date."""
    if kind == "text":
        return column.isNull() | (column == "")
    if kind == "date":
        return column.isNull()
    return column < F.lit(since).cast("timestamp_ntz")


def between(column: Column, low: str, high: str) -> Column:
    return column.between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz"))

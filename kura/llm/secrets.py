"""Secret scans with multipart credential linking.

Strong candidates (assignments, access identifiers, long hexadecimal runs) are reported on sight. Weak candidates
(a random-looking 40-character run; an endpoint) mean nothing alone. Access identifiers, secrets and endpoints
become intervals of a scope - a paragraph and, around each identifier, REACH characters - and an interval join
by start position pairs them; a weak candidate is reported only where a complementary part shares its scope:
a random run with an access identifier, an endpoint with an identifier or an assignment. Scopes are measured in code points.

Spans are (kind, start, end) in code points, end exclusive, ordered by start, then kind as listed in KINDS.

Defined results: null and empty texts have no spans; equal rows get equal spans; existing columns of the
outputs' names are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts_of, with_columns

KINDS = ("assign", "access", "hex", "paired", "endpoint")
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
RANDOM = re.compile(rb"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}={0,2}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(rb"(?:https?|wss?|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9_.:@/-]*[A-Za-z0-9_/-]")
#: Code points on either side of a part in which its complement is looked for.
REACH = 200
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


Spans = list[tuple[int, int]]


def near(parts: Spans, start: int, end: int, breaks: list[int]) -> bool:
    """Whether some part lies in the scope of start:end: within REACH, or in the same paragraph block. Parts are ordered and apart."""
    block = bisect_left(breaks, start)
    low = min(start - REACH, breaks[block - 1] if block else 0)
    high = max(end + REACH, breaks[block]) if block < len(breaks) else sys.maxsize
    at = bisect_left(parts, (low, 0))
    while at < len(parts) and parts[at][0] < high:
        if parts[at][1] <= high and (parts[at][1] <= start or parts[at][0] >= end):
            return True
        at += 1
    return False


def overlaps(spans: Spans, start: int, end: int) -> bool:
    at = bisect_left(spans, (start, 0))
    return any(s < end and e > start for s, e in spans[max(0, at - 1) : at + 1])


def mixed(word: bytes) -> bool:
    return bool(re.search(rb"[A-Z]", word) and re.search(rb"[a-z]", word) and re.search(rb"[0-9]", word))


def code_points(raw: bytes, cuts: set[int]) -> dict[int, int]:
    """From places in bytes to places in code points, in one sweep."""
    place, last, count = {}, 0, 0
    for cut in sorted(cuts):
        count += len(raw[last:cut].decode())
        place[cut], last = count, cut
    return place


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text. Candidates are sought in its bytes and paired by code points."""
    raw = text.encode()
    assign: Spans = [(m.start(), m.end()) for m in ASSIGN.finditer(raw.lower()) if m.end() - m.start(1) >= 6]
    access: Spans = [m.span() for m in ACCESS.finditer(raw)]
    hexes: Spans = [m.span() for m in HEX.finditer(raw)]
    endpoints: Spans = [m.span() for m in ENDPOINT.finditer(raw)] if (assign or access) and b"://" in raw else []
    random: Spans = [s for s in (m.span() for m in RANDOM.finditer(raw)) if mixed(raw[slice(*s)])] if access else []
    breaks = [m.start() for m in re.finditer(rb"\n\s*\n", raw)] if endpoints or random else []
    if len(raw) != len(text):
        place = code_points(raw, {x for some in (assign, access, hexes, endpoints, random) for s in some for x in s} | set(breaks))
        assign, access, hexes, endpoints, random = ([(place[s], place[e]) for s, e in some] for some in (assign, access, hexes, endpoints, random))
        breaks = [place[x] for x in breaks]
    out = [(kind, *s) for kind, some in zip(KINDS, (assign, access, hexes), strict=False) for s in some]
    out += [("endpoint", *s) for s in endpoints if near(access, *s, breaks) or near(assign, *s, breaks)]
    out += [("paired", *s) for s in random if not overlaps(assign, *s) and not overlaps(hexes, *s) and near(access, *s, breaks)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(df: DataFrame, text_col: str = "text", spans_col: str = "spans", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with spans_col array<struct<kind, start, end>>."""

    def make():
        def fn(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t)] for t in texts_of(batch, text_col)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            return [pa.array(rows, kind)]

        return fn

    return with_columns(df, text_col, [T.StructField(spans_col, SPAN)], make, drop)


def redact_text(text: str) -> str:
    """The text with each span's characters replaced by its kind in brackets; overlapping spans are joined."""
    out, last = [], 0
    for kind, start, end in find(text):
        if start >= last:
            out += [text[last:start], f"[{kind}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the spans of text_col masked; null stays null."""

    def make():
        return lambda batch: [pa.array([None if t is None else redact_text(t) for t in batch[text_col].to_pylist()], pa.string())]

    return with_columns(df, text_col, [T.StructField(text_col, T.StringType())], make).select(*df.columns)


def joined(spans, kinds: tuple[str, ...]):
    """kind:start:end of the spans of some kinds, comma-joined."""
    some = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

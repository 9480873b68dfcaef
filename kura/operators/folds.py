"""Rules whose answer for a row depends on the answers for earlier rows of its key: limiters and message packing.

Rows are dealt by key and sorted in their partitions, and one pass carries a key's state from batch to batch, so memory
is bounded by the rule's state and not by the number of rows a key has. As a rule of this kind is a sequence, a key is
one task's work."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], field: T.StructField, start: Callable[[], Callable]) -> DataFrame:
    """df with field: what start()'s function gives for the inputs of each row, a new function for each key. The order
    should end in a unique column."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != field.name), field])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = object(), None
        for batch in batches:
            out = []
            for key, row in zip(zip(*(batch[k].to_pylist() for k in keys), strict=True), zip(*(batch[c].to_pylist() for c in inputs), strict=True), strict=True):
                if key != last:
                    last, step = key, start()
                out.append(step(*row))
            kind = {"boolean": pa.bool_(), "bigint": pa.int64()}[field.dataType.simpleString()]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(out, kind)], names=[*names, field.name])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def sliding_window(df: DataFrame, keys: list[str], order: list[str], time: str, limit: int = 20, seconds: float = 60) -> DataFrame:
    """df with retry_after: 0 for an admitted row, else whole seconds to wait. Only admitted rows count against the
    limit. time is in seconds; a row whose time is null is refused for the whole window."""

    def start() -> Callable[[float | None], int]:
        admitted: deque[float] = deque()

        def step(now: float | None) -> int:
            if now is None:
                return math.ceil(seconds)
            while admitted and now - admitted[0] >= seconds:
                admitted.popleft()
            if len(admitted) < limit:
                admitted.append(now)
                return 0
            return max(1, math.ceil(admitted[0] + seconds - now))

        return step

    return fold(df, keys, order, [time], T.StructField("retry_after", T.LongType()), start)


def budget_window(df: DataFrame, keys: list[str], order: list[str], time: str, cost: str, limit: int, seconds: float, width: float) -> DataFrame:
    """df with retry_after for a budget of cost in a window. Admitted cost is kept by buckets of width seconds, and a
    bucket leaves the window with its latest row. Cost null counts as 0, a null time is refused for the window."""

    def start() -> Callable[[float | None, int | None], int]:
        buckets: dict[int, tuple[float, int]] = {}  # oldest first
        spent = 0

        def step(now: float | None, price: int | None) -> int:
            nonlocal spent
            if now is None:
                return math.ceil(seconds)
            while buckets and now - (oldest := next(iter(buckets.values())))[0] >= seconds:
                spent -= oldest[1]
                del buckets[next(iter(buckets))]
            over = spent + (price or 0) - limit
            if over <= 0:
                here = int(now // width)
                buckets[here] = (now, buckets.get(here, (now, 0))[1] + (price or 0))
                spent += price or 0
                return 0
            for latest, amount in buckets.values():
                over -= amount
                if over <= 0:
                    return max(1, math.ceil(latest + seconds - now))
            return math.ceil(seconds)

        return step

    return fold(df, keys, order, [time, cost], T.StructField("retry_after", T.LongType()), start)


def circuit_breaker(df: DataFrame, keys: list[str], order: list[str], time: str, bad: str, most: int = 3, seconds: float = 30, rest: float = 10) -> DataFrame:
    """df with shed: true while the breaker rests, which it does for rest seconds after most bad rows within seconds.
    Rows that are shed don't count; null is not bad; a null time is not shed."""

    def start() -> Callable[[float | None, bool | None], bool]:
        seen: deque[float] = deque(maxlen=most)
        closed_at = -math.inf

        def step(now: float | None, is_bad: bool | None) -> bool:
            nonlocal closed_at
            if now is None:
                return False
            if now < closed_at:
                return True
            if is_bad:
                seen.append(now)
                if len(seen) == most and now - seen[0] < seconds:
                    closed_at = now + rest
                    seen.clear()
            return False

        return step

    return fold(df, keys, order, [time, bad], T.StructField("shed", T.BooleanType()), start)


def message_batches(df: DataFrame, keys: list[str], order: list[str], line: str, frame: int, most: int = 10, chars: int = 1900, mark: int = 3) -> DataFrame:
    """df with batch, from 0 in each key: lines go to one message in order until it would hold more than most lines or
    chars characters. frame is the length of head and foot, mark what a line has besides its text; null is an empty
    line; a line longer than a message has one to itself."""

    def start() -> Callable[[str | None], int]:
        number, held, size = 0, 0, frame

        def step(text: str | None) -> int:
            nonlocal number, held, size
            more = len(text or "") + mark
            if held and (held == most or size + more > chars):
                number, held, size = number + 1, 0, frame
            held, size = held + 1, size + more
            return number

        return step

    return fold(df, keys, order, [line], T.StructField("batch", T.LongType()), start)

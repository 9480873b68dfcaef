"""Line dedup: pairwise alignment of the documents that share rare lines.

1. Lines are hashed (128 bits); those of one document alone part a text into runs of shared lines. A shared line is rare if
   it stands at most `rare` times in the whole table, else frequent; these are exact counts over all documents.
2. The holders of a rare line are the candidate pairs, an earlier document (lesser doc_id) and a later one. Each place of a
   rare line carries the frequent lines up to the next rare one, so a pair's shared lines are known without its texts.
3. A pair is aligned by patience: places of its rare lines grow into common blocks along each diagonal, and the blocks are dealt
   to piles that increase on both sides. The first pile is the main alignment; each further pile is one alignment more
   of what the piles before leave (moved passages). Blocks of at least min_words words go from the later document.
4. Blocks without a rare line (license text, boilerplate, large groups of copies) would give all pairs of their holders.
   There each document names its least such blocks - from every line on, and back from every line, as many lines as
   min_words words take - and is aligned with the first holder of each, a row for each and no pairs among the rest.

Both ways together delete just the lines that lie in a run of min_words words common with any earlier document, at any
place; tests hold the operator against that over all pairs. A document of fewer words goes when an earlier one has exactly
its lines. No line, block, holder or pair is too frequent or too many to count.

Lines are compared without white space at either end; lines without words count for nothing.

Defined results: null texts stay null; empty texts and rows with null doc_ids stay as they are; rows that share a doc_id
are documents of their own and none of them is earlier than another, rows equal in id and text are cut alike; lines
repeated inside one document only are kept; an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, by_key, chunks, fresh, materialize, release

#: Words of the smallest block that is deleted.
MIN_WORDS = 25
#: Most places of a line by which pairs are sought. Others are sought by blocks; results don't depend on it.
RARE = 8
LINES = "doc long, row long, pos int, words int, line long, line2 long"
EVIDENCE = "rare boolean, key long, key2 long, doc long, row long, start int, stop int, before long, own int, back array<long>, back_words array<int>, on array<long>, on_words array<int>"
BLOCKS = "doc long, row long, start int, stop int, pile int"


def worded(text: str) -> list[bytes]:
    """The lines with words, without white space at their ends."""
    return [x for x in (y.strip(WHITE) for y in text.encode().split(b"\n")) if x]


def lines(df: DataFrame, text_col: str, id_col: str, min_words: int) -> DataFrame:
    """A row for each line with words: its document, rank (pos), words and hash. A document of less than min_words words has one
    row more, at pos -1, with the hash of all of its lines and their number as words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                at, pos, words, marks = [], [], [], []
                for i, text in enumerate(batch["text"].to_pylist()):
                    own = worded(text)
                    many = [len(x.split()) for x in own]
                    hashes = [xxhash.xxh3_128_digest(x) for x in own]
                    if own and sum(many) < max(1, min_words):
                        at.append(i)
                        pos.append(-1)
                        words.append(len(own))
                        marks.append(xxhash.xxh3_128_digest(b"whole" + b"".join(hashes)))
                    at += [i] * len(own)
                    pos += range(len(own))
                    words += many
                    marks += hashes
                key = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
                of = pa.array(at, pa.int64())
                columns = [batch["doc"].take(of), batch["row"].take(of), pa.array(pos, pa.int32()), pa.array(words, pa.int32()), pa.array(key[:, 0]), pa.array(key[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "row", "pos", "words", "line", "line2"])

    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text")).mapInArrow(fresh(run), LINES)


def least_blocks(words: list[int], min_words: int) -> set[tuple[int, int]]:
    """First and last line of the blocks that take the fewest lines for min_words words, from each line on and back from each."""
    out, least, n = set(), max(1, min_words), len(words)
    end = total = 0
    for start in range(n):
        while total < least and end < n:
            total += words[end]
            end += 1
        if total < least:
            break
        out.add((start, end - 1))
        total -= words[start]
    start = total = 0
    for end in range(n):
        total += words[end]
        while total - words[start] >= least:
            total -= words[start]
            start += 1
        if total >= least:
            out.add((start, end))
    return out


def stretches(mask: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each stretch of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def evidence(shared: DataFrame, min_words: int, most: int) -> DataFrame:
    """Of the shared lines of each document, sorted, the places of rare lines and the least blocks of frequent ones."""
    least = max(1, min_words)

    def document(doc: int, row: int, pos: np.ndarray, words: np.ndarray, marks: np.ndarray, rare: np.ndarray, out: list[list]) -> None:
        def add(is_rare, key, start, stop, before=0, words=0, context=(None, None, None, None)):
            for o, v in zip(out, (is_rare, *key, doc, row, start, stop, before, words, *context), strict=True):
                o.append(v)

        if pos[0] < 0:
            add(False, marks[0].tolist(), 0, int(words[0]) - 1)
            pos, words, marks, rare = pos[1:], words[1:], marks[1:], rare[1:]
        cuts = (np.flatnonzero(np.diff(pos) != 1) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, pos.size], strict=True):
            if words[a:b].sum() < least:
                continue
            first, w, own, m = int(pos[a]), words[a:b], rare[a:b], marks[a:b]
            total = np.cumsum(w, dtype=np.int64)
            for s, e in stretches(~own):
                for x, y in least_blocks(w[s:e].tolist(), min_words):
                    key = np.frombuffer(xxhash.xxh3_128_digest(b"block" + m[s + x : s + y + 1].tobytes()), np.int64).tolist()
                    add(False, key, first + s + x, first + s + y)
            places = np.flatnonzero(own).tolist()
            for k, i in enumerate(places):
                low = places[k - 1] + 1 if k else 0
                high = places[k + 1] if k + 1 < len(places) else b - a
                context = [np.ascontiguousarray(x) for x in (m[low:i, 0][::-1], w[low:i][::-1], m[i + 1 : high, 0], w[i + 1 : high])]
                add(True, m[i].tolist(), first + i, first + i, int(total[i] - w[i]), int(w[i]), context)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rare", pa.bool_()), *((n, pa.int64()) for n in ("key", "key2", "doc", "row")), ("start", pa.int32()), ("stop", pa.int32()), ("before", pa.int64()), ("own", pa.int32()),
                            *((n, pa.list_(k)) for n, k in (("back", pa.int64()), ("back_words", pa.int32()), ("on", pa.int64()), ("on_words", pa.int32())))])
        for some in by_key(batches, ["doc", "row"]):
            if not some.num_rows:
                continue
            doc, row, pos, words, line, line2, n = (some[c].to_numpy() for c in ("doc", "row", "pos", "words", "line", "line2", "n"))
            cuts = (np.flatnonzero((np.diff(doc) != 0) | (np.diff(row) != 0)) + 1).tolist()
            marks, rare = np.stack([line, line2], axis=1), n <= most
            out: list[list] = [[] for _ in schema]
            for a, b in zip([0, *cuts], [*cuts, doc.size], strict=True):
                document(int(doc[a]), int(row[a]), pos[a:b], words[a:b], marks[a:b], rare[a:b], out)
            yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, schema, strict=True)], schema=schema)

    return shared.repartition("doc", "row").sortWithinPartitions("doc", "row", "pos").mapInArrow(fresh(run), EVIDENCE)


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column on end, and where each row begins."""
    whole = column.combine_chunks()
    sizes = pa.compute.list_value_length(whole).to_numpy(zero_copy_only=False).astype(np.int64)
    return whole.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])


def along(values: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many lines the contexts of rows a and b have in common from their beginning, and their words."""
    room = np.minimum(starts[a + 1] - starts[a], starts[b + 1] - starts[b])
    length, total, live, step = np.zeros(a.size, np.int64), np.zeros(a.size, np.int64), np.flatnonzero(room > 0), 0
    while live.size:
        x, y = starts[a[live]] + step, starts[b[live]] + step
        same = values[x] == values[y]
        live = live[same]
        length[live] += 1
        total[live] += words[y[same]]
        step += 1
        live = live[room[live] > step]
    return length, total


def matches(places: DataFrame, most: int) -> DataFrame:
    """For each two places of a rare line in an earlier and a later document, the common lines around: first and last in the later one,
    the diagonal (distance of the places), words of the run before and up to the end, of the later one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in by_key(batches, ["key", "key2"]):
            key, key2, doc, row, start, before = (some[c].to_numpy() for c in ("key", "key2", "doc", "row", "start", "before"))
            firsts, seconds = [], []
            for step in range(1, most):  # a key has at most that many rows
                i = np.arange(max(0, key.size - step))
                i = i[(key[i] == key[i + step]) & (key2[i] == key2[i + step]) & (doc[i] != doc[i + step])]
                firsts.append(i)
                seconds.append(i + step)
            a, b = np.concatenate([*firsts, []]).astype(int), np.concatenate([*seconds, []]).astype(int)  # sorted by doc, so a is earlier
            if not a.size:
                continue
            ahead = [lists(some[c]) for c in ("back", "on")]
            counted = [lists(some[c])[0] for c in ("back_words", "on_words")]
            (less, less_words), (more, more_words) = (along(*ahead[k], a, b, counted[k]) for k in (0, 1))
            own = some["own"].to_numpy()
            columns = {"doc": doc[b], "row": row[b], "other": doc[a], "other_row": row[a], "diagonal": start[b].astype(np.int64) - start[a], "start": (start[b] - less).astype(np.int32),
                       "stop": (start[b] + more).astype(np.int32), "before": before[b] - less_words, "upto": before[b] + own[b] + more_words}
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc long, row long, other long, other_row long, diagonal long, start int, stop int, before long, upto long"
    return places.repartition("key", "key2").sortWithinPartitions("key", "key2", "doc", "row", "start").mapInArrow(fresh(run), schema)


def piles(starts: list[int], ends: list[int]) -> list[int]:
    """Patience: the pile of each block, ordered by their places in the later document; in a pile places in the earlier one increase.
    A block goes on the pile that ends nearest before it."""
    tops: list[tuple[int, int]] = []  # last end and number of each pile
    out = []
    for start, end in zip(starts, ends, strict=True):
        at = bisect_left(tops, (start, -1)) - 1
        pile = tops.pop(at)[1] if at >= 0 else len(tops)
        insort(tops, (end, pile))
        out.append(pile)
    return out


def align(found: DataFrame, min_words: int) -> DataFrame:
    """The blocks of at least min_words words that patience aligns of each pair."""
    least = max(1, min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in by_key(batches, ["doc", "row", "other", "other_row"]):
            if not some.num_rows:
                continue
            doc, row, other, other_row, diagonal, start, stop, before, upto = (some[c].to_numpy() for c in ("doc", "row", "other", "other_row", "diagonal", "start", "stop", "before", "upto"))
            pair = np.cumsum(np.concatenate([[0], (np.diff(doc) != 0) | (np.diff(row) != 0) | (np.diff(other) != 0) | (np.diff(other_row) != 0)]))
            line = np.cumsum(np.concatenate([[0], (np.diff(pair) != 0) | (np.diff(diagonal) != 0)]))
            far = line * (1 << 32)
            reach = np.maximum.accumulate(far + stop)  # how far the matches up to here go on their diagonal
            new = np.concatenate([[True], far[1:] + start[1:] > reach[:-1] + 1])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], new.size) - 1
            last, many = reach[tail] - far[tail], np.maximum.reduceat(upto, head) - before[head]
            keep = many >= least
            head, last = head[keep], last[keep]
            if not head.size:
                continue
            order = np.lexsort((start[head], pair[head]))
            head, last = head[order], last[order]
            cuts = (np.flatnonzero(np.diff(pair[head])) + 1).tolist()
            pile: list[int] = []
            for a, b in zip([0, *cuts], [*cuts, head.size], strict=True):
                x = head[a:b]
                pile += piles((start[x] - diagonal[x]).tolist(), (last[a:b] - diagonal[x]).tolist()) if b - a > 1 else [0]
            yield pa.RecordBatch.from_pydict({"doc": doc[head], "row": row[head], "start": start[head], "stop": last.astype(np.int32), "pile": np.array(pile, np.int32)})

    pair = ("doc", "row", "other", "other_row")
    return found.repartition(*pair).sortWithinPartitions(*pair, "diagonal", "start").mapInArrow(fresh(run), BLOCKS)


def deletions(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """doc, row and gone: the blocks that go (start, stop: ranks among the lines with words; pile of the alignment)."""
    own = materialize(lines(df, text_col, id_col, min_words).distinct(), "line-hashes")  # rows equal in id and text once
    held = materialize(own.groupBy("line", "line2").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last")).where("last <> first").select("line", "line2", "n"), "line-counts")
    found = materialize(evidence(own.join(held, ["line", "line2"]), min_words, rare), "line-evidence")
    release(own, held)
    pairs = align(matches(found.where("rare").drop("rare", "stop"), rare), min_words)
    blocks = found.where("not rare").select("key", "key2", "doc", "row", "start", "stop")
    first = materialize(blocks.groupBy("key", "key2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("last <> first").drop("last"), "line-blocks")
    frequent = blocks.join(first, ["key", "key2"]).where("doc > first").select("doc", "row", "start", "stop", F.lit(0).alias("pile"))
    out = pairs.unionByName(frequent).groupBy("doc", "row").agg(F.collect_set(F.struct("start", "stop", "pile")).alias("gone"))
    out = materialize(out, "line-deletions")
    release(found, first)
    return out


def cut(text: str, gone: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the lines with words of these ranks, and how many went."""
    doomed = {i for a, b in gone for i in range(a, b + 1)}
    out, rank = [], 0
    for line in text.split("\n"):
        if line.strip("\x20\t\n\x0b\x0c\r"):
            rank += 1
            if rank - 1 in doomed:
                continue
        out.append(line)
    return "\n".join(out), len(doomed)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places by as few spans as can be."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS, removed_col: str = "n_removed", rare: int = RARE) -> DataFrame:
    """df with shortened texts and removed_col, the number of lines that went."""
    spans = deletions(df, text_col, id_col, min_words, rare)
    own = df.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(df.columns) if c != removed_col])
    columns = [c for c in df.columns if c != removed_col]
    text, doc = (own.columns[columns.index(c)] for c in (text_col, id_col))
    names = own.columns
    # Merged at every size: with spans broadcast while they are few, small inputs would not show what large ones shuffle.
    both = own.join(spans.hint("merge"), (F.col(doc) == F.col("doc")) & (F.xxhash64(text) == F.col("row")), "left").drop("doc", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, text):
                texts, removed = batch[text], [0] * batch.num_rows
                hit = np.flatnonzero(pa.compute.is_valid(batch["gone"]).to_numpy(zero_copy_only=False)).tolist()
                if hit:
                    texts = texts.to_pylist()
                    for i in hit:
                        texts[i], removed[i] = cut(texts[i], merged([(g["start"], g["stop"]) for g in batch["gone"][i].as_py()]))
                    texts = pa.array(texts, pa.string())
                arrays = [texts if c == text else batch[c] for c in names]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(removed, pa.int64())], names=[*names, "removed"])

    schema = T.StructType([*own.schema.fields, T.StructField("removed", T.LongType())])
    out = both.mapInArrow(fresh(run), schema)
    return out.select(*[F.col(o).alias(c) for o, c in zip(own.columns, columns, strict=True)], F.col("removed").alias(removed_col))


def keep_rest(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of df with shortened texts; a document goes when no word of it is left, as of copies."""
    out = dedup(df, text_col, id_col, removed_col="kura_removed", **options)
    empty = F.trim(F.col(text_col), F.lit("\x20\t\n\x0b\x0c\r")) == ""
    return out.where((F.col("kura_removed") == 0) | ~empty).select(*df.columns)

"""Best-fit packing: best-fit decreasing of token pieces into sequences, by classes of equal size.

Pieces and gaps are classes: an integer size of at most `capacity` and a run of ranks or of sequences. Classes of pieces are taken from
the longest down; each looks up its successor, the class of the least sufficient gaps, and the r-th piece takes the r-th gap, so ranks
settle every conflict; the gaps that are left go back at their new size and the next class follows. These rounds are about classes, not
rows: the plan has at most a few thousand runs however many documents there are, and is made on the driver. It gives what sweeps over
range-sorted rows would give. Rows then find their place by (length, rank), the rank being that of the row among all pieces of its
length: counts by task and length, summed, plus a rank in the task.

Defined results: a null or empty text is one piece (its end token); repeated rows are packed each for itself;
an empty table gives no rows; other columns aren't read. Only documents longer than capacity are cut.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from unicodedata import category

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import ForestBPE
from .common import Memo, chunks, materialize, one_at_a_time

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 2048
END = 0
#: Plain characters are below this code point: normalisation leaves them alone, and in lower case they are one character below it.
LATIN = 0x180
LETTER, NUMBER, OTHER = 1, 2, 3
#: By code point: how the tokenizer takes plain characters (0: not plain), and their lower case.
KIND = np.array([0 if c <= 0x20 or 0x7F <= c <= 0xA0 or c == 0x130 else {"L": LETTER, "N": NUMBER}.get(category(chr(c))[0], OTHER) for c in range(LATIN)], np.int8)
LOWER = np.array([ord(chr(c).lower()) if KIND[c] else c for c in range(LATIN)])
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, turn long"


class WordForest(ForestBPE):
    """Forest merges for a vocabulary file whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path) as f:
            model = json.load(f)["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        keys, ranks, result = [], [], []
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            keys.append(ids[left] << 32 | ids[right])
            ranks.append(len(ranks))
            result.append(ids[left + right])
        self.fill(np.array(keys, np.uint64), np.array(ranks, np.int64))
        self.result = np.array(result)
        # The vocabulary writes bytes that print as they are in Latin-1, and the others from 256 on.
        printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [i for i in range(256) if i not in printed]
        names = {i: chr(i) for i in printed} | {i: chr(256 + k) for k, i in enumerate(others)}
        self.single, self.last = (np.array([ids[names[i] + end] for i in range(256)], np.int64) for end in ("", suffix))

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """Of pieces of 1 to MOST bytes."""
        out: list[bytes] = [b""] * len(pieces)
        classes = defaultdict(list)
        for w, piece in enumerate(pieces):
            classes[1 << (len(piece) - 1).bit_length()].append(w)
        for size, members in classes.items():
            for a in range(0, len(members), 4096):
                some = members[a : a + 4096]
                for w, found in zip(some, self.grow([pieces[w] for w in some], size), strict=True):
                    out[w] = found
        return out


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The parts of data between offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def parts_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_binary array without nulls, and where each string begins and the last one ends."""
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(array) + 1, 8 * array.offset)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def listed(array: pa.Array) -> list[bytes]:
    return array.to_numpy(zero_copy_only=False).tolist()


def codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where characters of two bytes begin, their code points (0: not below LATIN), and which bytes belong to plain characters."""
    lead = np.flatnonzero(data >= 0x80)
    lead = lead[(data[lead] >= 0xC2) & (data[lead] < 0xC0 + (LATIN >> 6))]
    code = (data[lead] & 0x1F).astype(np.int64) << 6 | data[lead + 1] & 0x3F
    plain = (data < 0x80) & (KIND[data] > 0)
    plain[lead] = plain[lead + 1] = KIND[code] > 0
    return lead, code, plain


def cut(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of plain characters, which begin at first, as the tokenizer cuts them: their bytes in lower case, and where pieces begin."""
    lead, code, _ = codes(data)
    low = LOWER[data].astype(np.uint8)
    low[lead], low[lead + 1] = 0xC0 | LOWER[code] >> 6, 0x80 | LOWER[code] & 0x3F
    kind = KIND[low]
    kind[lead] = kind[lead + 1] = KIND[LOWER[code]]
    begins = np.ones(len(low), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    begins[lead + 1] = False
    begins[first] = True
    # A quote that begins a piece takes s, t, m, d, re, ve or ll of its word along, and what follows those begins another.
    ahead = np.concatenate([low, np.zeros(3, np.uint8)])
    starts = np.zeros(len(ahead), bool)
    starts[first] = True
    quote = np.flatnonzero((low == ord("'")) & begins)
    one, two = ahead[quote + 1], ahead[quote + 2]
    inside = ~starts[quote + 1]
    short = inside & np.isin(one, list(b"stmd"))
    long = inside & ~starts[quote + 2] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    for at, n in ((quote[short], 2), (quote[long], 3)):
        begins[at + 1] = False
        after = at + n
        begins[after[after < len(begins)]] = True
    return low, np.flatnonzero(begins)


def by_library(tokenizer: Tokenizer, words: list[bytes]) -> list[bytes]:
    found = tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
    return [np.array(e.ids, np.int32).tobytes() for e in found]


class WordIds:
    """Ids of words between ASCII white space. White space is dropped by the tokenizer, and nothing in it reaches across, so words are
    read one by one; those of plain characters are cut and go through the forest by pieces, and others and words with the string of a
    special token go to the library, which by default reads it as that token. Long pieces go there too."""

    def __init__(self, path: str):
        tokenizer, forest = Tokenizer.from_file(path), WordForest(path)
        self.special = [t.content.lower() for t in tokenizer.get_added_tokens_decoder().values()]
        self.most = forest.MOST
        self.pieces, self.words = Memo(forest.ids), Memo(partial(by_library, tokenizer), 1 << 17)

    def plain(self, words: pa.Array) -> np.ndarray:
        """Which words aren't for the library."""
        data, offsets = parts_of(words.cast(pa.large_binary()))
        odd = np.concatenate([np.zeros(1, np.int64), np.cumsum(~codes(data)[2])])
        out = (np.diff(odd[offsets]) == 0) & (np.diff(offsets) > 0)
        low = pa.compute.ascii_lower(words)
        for s in self.special:
            out &= ~pa.compute.match_substring(low, s).to_numpy(zero_copy_only=False)
        return out

    def of_plain(self, words: pa.Array) -> tuple[bytes, np.ndarray]:
        """The ids of all words on end, and where, in bytes, each word's end."""
        data, offsets = parts_of(words.cast(pa.large_binary()))
        low, begins = cut(data, offsets[:-1])
        coded = strings(low, np.append(begins, len(low))).dictionary_encode()
        distinct = listed(coded.dictionary)
        if (np.diff(parts_of(coded.dictionary)[1]) > self.most).any():
            long = {p for p in distinct if len(p) > self.most}
            short, rest = self.pieces.learn([[p for p in distinct if p not in long]]), self.words.learn([long])
            found = [rest(p) if p in long else short(p) for p in distinct]
        else:
            found = list(map(self.pieces.learn([distinct]), distinct))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        values = strings(np.frombuffer(b"".join(found), np.uint8), np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]))
        ids, ends = parts_of(values.take(coded.indices))
        return ids.tobytes(), ends[np.searchsorted(begins, offsets)[1:]]

    def of(self, words: pa.Array) -> pa.Array:
        """The ids of each word, as int32 strings."""
        plain = self.plain(words)
        others = listed(words.filter(pa.array(~plain)).cast(pa.binary()))
        found = list(map(self.words.learn([others]), others))
        ids, ends = self.of_plain(words.filter(pa.array(plain)))
        more = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) + len(ids)
        place = np.empty(len(words), np.int64)
        place[plain], place[~plain] = np.arange(len(ends)), len(ends) + np.arange(len(found))
        return strings(np.frombuffer(ids + b"".join(found), np.uint8), np.concatenate([np.zeros(1, np.int64), ends, more])).take(pa.array(place))


@one_at_a_time
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def ids_of(texts: pa.Array, model: WordIds) -> tuple[np.ndarray, list[int]]:
    """The ids of all texts on end, and where each text begins and the last one ends. Each distinct word is looked up
    once; its ids are then copied to every place it has."""
    words = pa.compute.ascii_split_whitespace(pa.compute.fill_null(texts, ""))
    coded = words.flatten().dictionary_encode()
    ids, past = parts_of(model.of(coded.dictionary).take(coded.indices))
    offsets = words.offsets.to_numpy()
    return ids.view(np.int32), (past[offsets - offsets[0]] // 4).tolist()


def pieces(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """The pieces of every row, each with its rank (turn) among the pieces of its length in its task (part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part, seen = word_ids(path), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([END], np.int32).tobytes()
        for whole in batches:
            for batch in chunks(whole, "text"):
                ids, bounds = ids_of(batch["text"], memo)
                rows = []
                for doc, first, past in zip(batch["doc_id"].to_pylist(), bounds, bounds[1:], strict=False):
                    raw = ids[first:past].tobytes() + end
                    for piece, a in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[a : a + 4 * capacity]
                        n = len(own) // 4
                        rows.append((doc, piece, a // 4, n, zlib.crc32(own), part, seen[n]))
                        seen[n] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "turn")
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first sequence, offset): that many pieces of that length by rank go to
    that many sequences by number, one in each."""
    runs, sequences = [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by free size: (first sequence, how many)
    sizes: list[int] = []

    def give(size: int, first: int, many: int) -> None:
        if size and many:
            if not gaps[size]:
                insort(sizes, size)
            gaps[size].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                size = sizes[at]
                first, many = gaps[size].pop()
                if not gaps[size]:
                    sizes.pop(at)
                take = min(left, many)
                give(size, first + take, many - take)
            else:
                size, first, take = capacity, sequences, -(-left // (capacity // length))
                sequences += take
            runs.append((length, rank, take, first, capacity - size))
            give(size - length, first, take)
            left, rank = left - take, rank + take
    return runs


def pack(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = df.sparkSession
    cut = materialize(pieces(df, text_col, id_col, capacity, path), "packing-pieces")
    by_task = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    by_task = materialize(by_task, "packing-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = by_task.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cut.join(first, ["length", "part"]).withColumn("rank", F.col("before") + F.col("turn"))
    runs = sorted(plan(counts, capacity))
    held = spark.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 5))  # runs of classes, bounded by capacity and not by rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = (batch[c].to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

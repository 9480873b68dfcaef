"""Byte-level BPE encoding and decoding.

Each match of the split pattern is a run of bytes. A segment tree over its byte positions holds, at the position
where a live token starts, the rank of the pair it forms with its right neighbour; inner nodes hold the minimum
of (rank, position), so the root is the leftmost pair of least rank. A merge updates three leaves (the merged
token, its left neighbour, the swallowed right one), each in logarithmic time.

Defined results: null and empty texts have no ids and decode to no bytes; rows keep their multiplicity; an
existing column of the output's name is replaced; other columns pass through.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Memo, lists_of, texts_of, with_columns

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
NONE = 1 << 62
POSITION = (1 << 32) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class SegmentTreeBPE:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pattern match, by a tree of its own."""
        ranks, longest, n = self.ranks, self.longest, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        if not n:
            return []
        size = 1 << max(n - 1, 0).bit_length()
        tree = [NONE] * (2 * size)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i: int) -> int:
            j = end[i]
            if j >= n or end[j] - i > longest:
                return NONE
            rank = ranks.get(piece[i : end[j]])
            return NONE if rank is None else rank << 32 | i

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                least = min(tree[i], tree[i ^ 1])
                i >>= 1
                if tree[i] == least:
                    return
                tree[i] = least

        for i in range(n - 1):
            tree[size + i] = pair(i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while tree[1] != NONE:
            i = tree[1] & POSITION
            j = end[i]
            end[i] = end[j]
            if end[i] < n:
                before[end[i]] = i
            put(j, NONE)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out



class ForestBPE(SegmentTreeBPE):
    """The same trees for many short matches at once: row w of each array is the tree of match w."""

    #: Longest match in bytes that is put into a forest; a longer one gets a tree of its own.
    MOST = 64

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.fill(np.array(keys, np.uint64), np.array(values, np.int64))
        #: The id of a byte, of a match's last byte, and of what a pair of some rank merges to.
        self.single = self.last = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.result = np.arange(max(ranks.values()) + 1)

    def fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table of the pairs, at most a quarter full."""
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, NONE, np.uint64)
        self.slot_value = np.zeros(1 << bits, np.int64)
        at, left, self.probes = self.hash(keys), np.arange(len(keys)), 0
        while left.size:
            free = left[self.slot_key[at[left]] == NONE]
            self.slot_key[at[free]] = keys[free]
            won = free[self.slot_key[at[free]] == keys[free]]
            self.slot_value[at[won]] = values[won]
            left = np.setdiff1d(left, won)
            at[left] = at[left] + 1 & self.mask
            self.probes += 1

    def hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray, position: np.ndarray) -> np.ndarray:
        """rank << 32 | position of the pairs that merge, NONE of the others."""
        key = (left << 32 | right).astype(np.uint64)
        at = self.hash(key)
        out = np.full(key.shape, NONE, np.int64)
        open_ = np.arange(key.size)
        for _ in range(self.probes):
            found = self.slot_key.take(at)
            hit = found == key
            to = open_[hit]
            out[to] = self.slot_value.take(at[hit]) << 32 | position[to]
            more = ~hit & (found != NONE)
            if not more.any():
                break
            open_, key, at = open_[more], key[more], at[more] + 1 & self.mask
        return out

    def grow(self, pieces: list[bytes], size: int) -> list[bytes]:
        """The ids, as int32 strings, of pieces of at most size bytes; size is a power of two.

        The arrays are flat: tree w begins at w * 2 * size, its tokens at w * (size + 1)."""
        many, wide = len(pieces), size + 1
        length = np.array([len(p) for p in pieces])
        chars = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(many, size)
        at = np.arange(wide)
        token = np.zeros((many, wide), np.int64)
        token[:, :size] = self.single[chars]
        token[np.arange(many), length - 1] = self.last[chars[np.arange(many), length - 1]]
        after = np.tile(at + 1, many)
        before = np.tile(at - 1, many)
        live = at < length[:, None]
        tree = np.full((many, 2 * size), NONE, np.int64)
        pairs = np.flatnonzero(at[:size] + 1 < length[:, None])
        w, i = pairs // size, pairs % size
        tree[w, size + i] = self.rank(token[w, i], token[w, i + 1], i)
        level = size
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        token, live, tree = token.ravel(), live.ravel(), tree.ravel()
        row = np.arange(many)
        while True:
            root = tree.take(row * (2 * size) + 1)
            row, root = row[root != NONE], root[root != NONE]
            if not row.size:
                break
            base, top, n = row * wide, row * (2 * size), length.take(row)
            i = root & POSITION
            j = after.take(base + i)
            k = after.take(base + j)
            merged = self.result.take(root >> 32)
            token[base + i], after[base + i], before[base + k], live[base + j] = merged, k, i, False
            p = before.take(base + i)
            right, left = np.flatnonzero(k < n), np.flatnonzero(p >= 0)
            value_i = np.full(row.size, NONE, np.int64)
            value_i[right] = self.rank(merged[right], token.take(base[right] + k[right]), i[right])
            tree[top + size + j] = NONE
            tree[top + size + i] = value_i
            tree[top[left] + size + p[left]] = self.rank(token.take(base[left] + p[left]), merged[left], p[left])
            node = np.concatenate([i, j, p[left]]) + size
            start = np.concatenate([top, top, top[left]])
            for _ in range(size.bit_length() - 1):
                node >>= 1
                low = start + 2 * node
                tree[start + node] = np.minimum(tree.take(low), tree.take(low + 1))
        ids = token[live].astype(np.int32).tobytes()
        ends = (np.cumsum(live.reshape(many, wide).sum(1)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each match, as int32 strings."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for w, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is None and 1 < len(piece) <= self.MOST:
                classes.setdefault(1 << (len(piece) - 1).bit_length(), []).append(w)
            else:
                out[w] = np.array(self.merge(piece), np.int32).tobytes()
        for size, members in classes.items():
            for a in range(0, len(members), 4096):
                some = members[a : a + 4096]
                for w, ids in zip(some, self.grow([pieces[w] for w in some], size), strict=True):
                    out[w] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Memo:
    """From matches to int32 strings of ids; kept for the life of a Python worker."""
    bpe = ForestBPE(load_ranks(path))
    return Memo(lambda pieces: bpe.merge_all([p.encode() for p in pieces]))


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, drop: tuple[str, ...] = ()) -> DataFrame:
    """df with ids_col array<int>."""

    def make():
        split, ids = regex.compile(pattern).findall, encoder(path)

        def fn(batch: pa.RecordBatch) -> list[pa.Array]:
            pieces = [split(t) for t in texts_of(batch, text_col)]
            get = ids.learn(pieces)
            return [lists_of([b"".join(map(get, p)) for p in pieces])]

        return fn

    return with_columns(df, text_col, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], make, drop)


def decode(df: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded", path: str = VOCABULARY) -> DataFrame:
    """df with bytes_col binary; null ids give no bytes. An id that the vocabulary lacks raises KeyError."""
    names = [f for f in df.schema.fields if f.name != bytes_col]
    schema = T.StructType([*names, T.StructField(bytes_col, T.BinaryType())])
    columns = [f.name for f in names]

    def run(batches):
        token = {i: b for b, i in load_ranks(path).items()}
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                out = [b"".join(map(token.__getitem__, i.values.to_numpy(zero_copy_only=False).tolist() if i.is_valid else ())) for i in batch[ids_col]]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(out, pa.binary())], names=[*columns, bytes_col])

    return df.mapInArrow(run, schema)

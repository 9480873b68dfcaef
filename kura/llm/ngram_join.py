"""N-gram Jaccard join by signature trees.

A document's set is its distinct word n-grams. Documents with equal sets are one class. The collection is one forest of
signature trees: its first level parts the classes by the tokens of their prefixes (sets that link share one of their
first tokens in any common order; tokens that are frequent come last in the order, so the parts - blocks - stay small), and
in each block a tree is built over the classes, ordered by size: nodes hold the OR of their members' token bitmaps, the
size range and the most tokens without a bit of their own, and a dual traversal drops node pairs whose maximum possible
overlap is too small. Before that, members that no other member of their block can link with, by the most overlap that the
counts of their tokens in PLACES ranges allow, leave the block, so that only sets with a possible partner are read again. Bitmaps are laid out in the block, over the token fingerprints that two or more members hold, so
that near misses are told apart there. Of the pairs that are left only those that connect something new in the block are
emitted, and are checked on the sets; a block where a check fails is traversed again without that pair, and with TRIES more
pairs a member, until none fails. So no link between components is missed, and a block's pairs in a round are in proportion
to its members.

A block of more than PART members is dealt to parts by hash, with some members (leaders) in all of them, and each part is a
tree of its own. In a large group of near copies the leaders connect the parts. What is then not in the largest
component of the block is held against all of its members, part by part, with what is connected already marked, so no
pair of parts is traversed whole unless the block has little in common.

Defined results: null, empty and white-space texts have an empty set (n_shingles 0) and link with nothing; a text
of fewer words than n has one shingle, the whole sequence; repeated rows are linked; null doc_ids are dropped from
the links but keep their row (component_id null). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, chunks, fresh, materialize, release, texts_of, tidy

ODD = np.uint64(0x9E3779B97F4A7C15)
#: At most so many frequent tokens are sent to all tasks; with fewer than LEAST rows a token isn't frequent.
MOST_FREQUENT, LEAST = 1 << 18, 24
#: Members of a block's part; about LEADERS members stand in all parts of a block.
PART, LEADERS = 1024, 16
#: Most tokens of the sets of a part, by which sets are decoded in one task.
TOKENS = 1 << 23
#: Bytes of the bitmaps of a block's members.
ROOM = 64 << 20
LEAF = 8
#: Pairs of a member that a round tries beside those that connect something.
TRIES = 32
#: Most members of a block whose pairs are held against the positions of its token.
MATRIX = 256
#: Ranges of tokens, by their high bits, in which a sketch counts a set's tokens; sets of more than COUNTED tokens may pass a count.
PLACES, COUNTED = 64, 65535
#: Bits of the map of ids by which rows are passed over before they are joined.
ID_BITS = 1 << 26


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    end = len(words) - k + 1
    s = h[:end].copy()
    for j in range(1, k):
        s = (s * ODD ^ s >> np.uint64(29)) + h[j : end + j]
    s *= ODD
    s ^= s >> np.uint64(32)
    s *= ODD
    return np.unique(s)


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1 if size else 0


def width(size: int) -> int:
    """Bits of a set's fingerprints: a range of 4,096 to 8,192 times its size, so that few tokens share one."""
    return max(size - 1, 3).bit_length() + 12


def prints(tokens: np.ndarray) -> bytes:
    """The fingerprints, low bits of the tokens, in order: gaps in two bytes each, with 65535 for every 65535 passed over."""
    low = np.sort((tokens & np.uint64((1 << width(tokens.size)) - 1)).astype(np.int64))
    over, rest = np.divmod(np.diff(low, prepend=0), 65535)
    out = np.full(low.size + int(over.sum()), 65535, np.uint16)
    out[np.cumsum(over + 1) - 1] = rest
    return out.tobytes()


def fingerprints(coded: bytes) -> np.ndarray:
    gaps = np.frombuffer(coded, np.uint16)
    return np.cumsum(gaps, dtype=np.int64)[gaps < 65535].astype(np.uint32)


def sketch(tokens: np.ndarray) -> bytes:
    """How many of the tokens lie in each of PLACES ranges."""
    places = (tokens >> np.uint64(65 - PLACES.bit_length())).astype(np.int64)
    return np.minimum(np.bincount(places, minlength=PLACES), COUNTED).astype(np.uint16).tobytes()


def bitmaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A row of bits for each set over the fingerprints that two or more sets hold, and how many of a set's tokens
    have no bit of their own. An overlap is at most the common bits plus the lesser of these counts."""
    flat = np.concatenate(sets)
    flat.sort()
    shared = np.unique(flat[1:][flat[1:] == flat[:-1]])
    # wide enough for a bit each, but no wider than ROOM bytes for all sets allow; then bits are shared
    bits = 64 * max(1, min(-(-shared.size // 64), ROOM // (8 * len(sets))))
    rows, held = np.zeros((len(sets), bits // 8), np.uint8), np.zeros(len(sets), np.int64)
    for i, some in enumerate(sets if shared.size else ()):
        at = np.searchsorted(shared, some)
        at = at[shared[np.minimum(at, shared.size - 1)] == some] % bits
        held[i] = at.size
        np.bitwise_or.at(rows[i], at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    rows = rows.view(np.uint64)
    return rows, held - np.bitwise_count(rows).sum(1, dtype=np.int64)


class Forest:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def flat(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up


def need(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of sets of these sizes that links."""
    return -(-percent * (a + b) // (100 + percent))


def children(left: np.ndarray, right: np.ndarray, many: int, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(LEAF)
    a = (left[:, None, None] * LEAF + step[:, None]) + np.zeros(LEAF, np.int64)
    b = (right[:, None, None] * LEAF + step) + np.zeros((LEAF, 1), np.int64)
    ok = (a < many) & (b < many) & ((a <= b) | ~same[:, None, None])
    return a[ok], b[ok]


def tree_pairs(sizes: np.ndarray, bits: np.ndarray, spare: np.ndarray, percent: int, parts: Callable[[], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Member pairs that may link, from a dual traversal; members are ordered by size, bits has a row for each. Node pairs all of
    whose members are in one component by parts(), which is asked again and again, are passed over."""
    levels = [(bits, sizes, sizes, spare)]
    while len(levels[-1][1]) > LEAF:
        ors, low, high, most = levels[-1]
        cuts = np.arange(0, len(low), LEAF)
        levels.append((np.bitwise_or.reduceat(ors, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(most, cuts)))
    top = len(levels[-1][1])
    a, b = np.triu_indices(top)
    todo = [(len(levels) - 1, a, b)]
    while todo:
        level, a, b = todo.pop()
        limit = max(64, (1 << 20) // bits.shape[1])
        if a.size > limit:
            todo.append((level, a[limit:], b[limit:]))
            a, b = a[:limit], b[:limit]
        ors, low, high, most = levels[level]
        if level == 0:
            a, b = a[a < b], b[a < b]
        fits = 100 * np.minimum(high[a], high[b]) >= percent * np.maximum(low[a], low[b])
        a, b = a[fits], b[fits]
        low_part = high_part = parts()
        for _ in range(level):
            cuts = np.arange(0, len(low_part), LEAF)
            low_part, high_part = np.minimum.reduceat(low_part, cuts), np.maximum.reduceat(high_part, cuts)
        apart = (low_part[a] != high_part[b]) | (low_part[b] != high_part[a])
        a, b = a[apart], b[apart]
        if not a.size:
            continue
        overlap = np.bitwise_count(ors[a] & ors[b]).sum(1, dtype=np.int64) + np.minimum(most[a], most[b])
        fits = overlap >= need(low[a], low[b], percent)
        a, b = a[fits], b[fits]
        if not a.size:
            continue
        if level == 0:
            yield a, b
        else:
            todo.append((level - 1, *children(a, b, len(levels[level - 1][1]), a == b)))


def connect(sizes: np.ndarray, sets: list[np.ndarray], percent: int, linked: list[tuple[int, int]], failed: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs that may link and connect members of a block that linked doesn't connect yet; sets has fingerprints."""
    n = len(sizes)
    forest, known, out = Forest(n), Forest(n), []
    for a, b in linked:
        forest.join(a, b)
        known.join(a, b)
    roots, tries = known.flat(), np.full(n, TRIES if failed else 0)
    wide = np.array([width(z) for z in sizes.tolist()])
    reach = (-(-100 // percent) - 1).bit_length()  # bits by which sizes that link may differ
    for w in np.unique(wide).tolist():
        own = np.flatnonzero((wide >= w) & (wide <= w + reach))
        if own.size < 2:
            continue
        own = own[np.argsort(sizes[own], kind="stable")]
        held = [sets[i] & np.uint32((1 << w) - 1) for i in own]
        for a, b in tree_pairs(sizes[own], *bitmaps(held), percent, lambda own=own: (roots if failed else forest.flat())[own]):
            a, b = own[a], own[b]
            now = forest.flat()
            new = (now[a] != now[b]) | (roots[a] != roots[b]) & ((tries[a] > 0) | (tries[b] > 0))
            for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True):
                if (min(x, y), max(x, y)) not in failed and (forest.join(x, y) or roots[x] != roots[y] and (tries[x] > 0 or tries[y] > 0)):
                    out.append((x, y))
                    tries[x] -= 1
                    tries[y] -= 1
    return out


def profile(df: DataFrame, n: int, percent: int, heavy=None) -> DataFrame:
    """doc_id, size, key, prefix; with heavy, a broadcast sorted array of frequent tokens, also sketch."""
    fields = "doc_id long, size long, key long, key2 long, prefix array<long>" + (", sketch binary" if heavy else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = heavy.value if heavy else None
        for whole in batches:
            for batch in chunks(whole, "text"):
                words = [words_of(t) for t in texts_of(batch, "text")]
                out: list[list] = [[], [], [], [], []]
                for some in words:
                    s = shingles(some, n)
                    digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    order = s
                    p = prefix_length(s.size, percent)
                    if frequent is not None:
                        if s.size:
                            at = np.searchsorted(frequent, s)
                            is_heavy = frequent[np.minimum(at, frequent.size - 1)] == s if frequent.size else np.zeros(s.size, bool)
                            order = np.concatenate([s[~is_heavy], s[is_heavy]])
                        out[4].append(sketch(s))
                    for o, v in zip(out, (s.size, digest[0], digest[1], order[:p].view(np.int64)), strict=False):
                        o.append(v)
                arrays = [batch["doc_id"], *(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.list_(pa.int64()))]
                names = ["doc_id", "size", "key", "key2", "prefix"]
                if heavy:
                    arrays, names = [*arrays, pa.array(out[4], pa.binary())], [*names, "sketch"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(fresh(run), fields)


def dealt(profiles: DataFrame) -> DataFrame:
    """token, part, parts, key, place (size and position in the order) of each prefix token of each class. The members of a token that
    has more than PART of them, or more than TOKENS tokens in all, are dealt to parts; LEADERS or so stand in each."""
    tokens = profiles.select(F.posexplode("prefix").alias("at", "token"), "key", "size").select("token", "key", (F.shiftleft("size", 32) + F.col("at")).alias("place"))
    size = F.shiftright("place", 32)
    some = materialize(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total")).where((F.col("n") > PART) | (F.col("total") > TOKENS)), "ngram-hot")
    parts = F.greatest(F.ceil(F.col("n") / PART), F.ceil(F.col("total") / TOKENS)).cast("int")
    tokens = tokens.join(some.select("token", "n", parts.alias("parts")), "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    leads = F.pmod(F.xxhash64("key", F.lit("lead")), F.greatest(F.lit(1), F.floor(F.col("n") / LEADERS))) == 0
    places = F.when((F.col("parts") > 1) & leads, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")))
    return tokens.select("token", F.explode(places).alias("part"), "parts", "key", "place")


def blocks(tokens: DataFrame, percent: int) -> DataFrame:
    """block, key: the members of each part of a token that has at least two classes; equal blocks of several tokens once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, None] = {}
        for some in by_key(batches, ["token", "part"]):
            if not some.num_rows:
                continue
            token, part, key, place = (some[c].to_numpy() for c in ("token", "part", "key", "place"))
            size, position = place >> 32, place & 0xFFFFFFFF
            starts = np.concatenate([[0], np.flatnonzero((np.diff(token) != 0) | (np.diff(part) != 0)) + 1])
            ends = np.append(starts[1:], token.size)
            big = ends - starts > 1
            ids, members = [], []
            for a, b in zip(starts[big].tolist(), ends[big].tolist(), strict=True):
                k, first = np.unique(key[a:b], return_index=True)
                if k.size < 2:
                    continue
                s, after = size[a:b][first], (size - position)[a:b][first]
                if k.size <= MATRIX:
                    # where this token is the first that two sets share, what follows it bounds their overlap
                    may = np.minimum(after[:, None], after) >= need(s[:, None], s, percent)
                    np.fill_diagonal(may, False)
                    k = k[may.any(1)]
                else:
                    order = np.argsort(s, kind="stable")
                    k, s = k[order], s[order]
                    near = 100 * s[:-1] >= percent * s[1:]
                    k = np.sort(k[np.append(near, False) | np.append(False, near)])
                if k.size < 2:
                    continue
                block = xxhash.xxh3_64_intdigest(k.tobytes()) - (1 << 63)
                if block not in seen:
                    if len(seen) >= 1 << 18:
                        seen.clear()
                    seen[block] = None
                    ids.append(np.full(k.size, block, np.int64))
                    members.append(k)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(members))], names=["block", "key"])

    rows = tokens.select("token", "part", "key", "place")
    return rows.repartition("token", "part").sortWithinPartitions("token", "part").mapInArrow(fresh(run), "block long, key long").distinct()


def rest_blocks(hot: DataFrame, label: DataFrame) -> DataFrame:
    """block, key, component: for each token in several parts, what is outside of the largest component among its members beside
    all members, part by part. hot has token, parts, key."""
    named = hot.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    many = named.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = many.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), (F.sum("n") - F.max("n")).alias("others"))
    named = materialize(named.join(largest, "token").where("others > 0"), "ngram-hot-members")
    pieces = F.ceil(F.col("others") / PART).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    whole = named.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("piece", every(pieces))
    others = named.where("component <> largest").withColumn("piece", F.pmod(F.xxhash64("key"), pieces).cast("int")).withColumn("part", every(F.col("parts")))
    columns = [F.xxhash64("token", "part", "piece").alias("block"), "key", "component"]
    return whole.select(*columns).union(others.select(*columns)).distinct()


def sift(members: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The members that may link with another one of their block, not of their component: an overlap is at most the sum, over all
    ranges of tokens, of the lesser counts. Blocks that are equal then are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in by_key(batches, ["block"]):
            if not some.num_rows:
                continue
            block, size = some["block"].to_numpy(), some["size"].to_numpy()
            part, alone = some["component"].fill_null(0).to_numpy(), some["component"].is_null().to_numpy()
            counts = np.frombuffer(b"".join(some["sketch"].to_pylist()), np.uint16).reshape(-1, PLACES)
            keep = np.zeros(block.size, bool)
            left, step = np.arange(block.size), 0
            while left.size:  # members with a later one step places on, in order of size; sizes only move apart
                step += 1
                left = left[left + step < block.size]
                right = left + step
                left = left[(block[left] == block[right]) & (100 * size[left] >= percent * size[right])]
                a, b = left, left + step
                ask = ~(keep[a] & keep[b]) & (alone[a] | alone[b] | (part[a] != part[b]))
                a, b = a[ask], b[ask]
                most = np.minimum(counts[a], counts[b]).sum(1, dtype=np.int64)
                may = (most >= need(size[a], size[b], percent)) | (size[b] > COUNTED)
                keep[a[may]] = keep[b[may]] = True
            if keep.any():
                rest = some.select(["block", "key", "component"]).filter(pa.array(keep)).sort_by([("block", "ascending"), ("key", "ascending")])
                block, key = rest["block"].to_numpy(), rest["key"].to_numpy()
                starts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1])
                ends = np.append(starts[1:], block.size)
                ids = [xxhash.xxh3_64_intdigest(key[a:b].tobytes()) - (1 << 63) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield from rest.set_column(0, "block", pa.array(np.repeat(np.array(ids, np.int64), ends - starts))).to_batches()

    rows = members.join(profiles.select("key", "size", "sketch"), "key").select("block", "key", "component", "size", "sketch")
    return rows.repartition("block").sortWithinPartitions("block", "size").mapInArrow(fresh(run), "block long, key long, component long").distinct()


def likely(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """doc_id, text and prints (the fingerprints of the text's set) of all docs whose doc_id is in ids and of few others: a map of ID_BITS bits, at most 8 MB, is sent to all tasks."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS)) + 1
    parts = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros(ID_BITS // 8, np.uint8)
    for r in parts.collect():
        own = np.frombuffer(r["bits"], np.uint8)
        bits[(r["bucket"] - 1) * own.size :][: own.size] = own
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole["place"].to_numpy() - 1
            found = whole.select(["doc_id", "text"]).filter(pa.array((held.value[at >> 3] >> (at & 7) & 1).astype(bool)))
            for batch in chunks(found, "text"):
                coded = [prints(shingles(words_of(t), n)) for t in texts_of(batch, "text")]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(coded, pa.binary())], names=["doc_id", "text", "prints"])

    return docs.where("doc_id is not null").select("doc_id", "text", place.alias("place")).mapInArrow(fresh(run), "doc_id long, text string, prints binary")


def candidates(members: DataFrame, classes: DataFrame, tried: DataFrame | None, percent: int) -> DataFrame:
    """block, a, b: pairs of keys to check. Members of equal component are linked already; null is none."""
    null = lambda kind: F.lit(None).cast(kind)
    rows = members.join(classes.select("key", "size", "prints"), "key").select("block", F.col("key").alias("a"), null("long").alias("b"), "size", "prints", null("boolean").alias("linked"), "component")
    if tried is not None:
        rows = rows.unionByName(tried.select("block", "a", "b", null("long").alias("size"), null("binary").alias("prints"), "linked", null("long").alias("component")))

    def run(group: pa.Table) -> pa.Table:
        pair = group["b"].is_valid().to_numpy()
        here = group.filter(pa.array(~pair))
        key = here["a"].to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        sizes = here["size"].to_numpy()[order]
        sets = [fingerprints(m) for m in here["prints"].take(pa.array(order)).to_pylist()]
        old = group.filter(pa.array(pair))
        a, b = (np.searchsorted(key, old[c].to_numpy()).tolist() for c in ("a", "b"))
        ok = old["linked"].to_pylist()
        linked = [p for p, o in zip(zip(a, b, strict=True), ok, strict=True) if o]
        failed = {(min(p), max(p)) for p, o in zip(zip(a, b, strict=True), ok, strict=True) if not o}
        first: dict[int, int] = {}
        for i, part in enumerate(here["component"].take(pa.array(order)).to_pylist()):
            if part is not None and first.setdefault(part, i) != i:
                linked.append((first[part], i))
        pairs = connect(sizes, sets, percent, linked, failed)
        x, y = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
        block = group["block"][0].as_py()
        return pa.table({"block": np.full(x.size, block, np.int64), "a": np.minimum(key[x], key[y]), "b": np.maximum(key[x], key[y])})

    return rows.groupBy("block").applyInArrow(run, "block long, a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b, linked for distinct pairs of keys; texts has key, text."""
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "ta"):
                words = [[words_of(t) for t in texts_of(batch, c)] for c in ("ta", "tb")]
                linked = []
                for x, y in zip(*words, strict=True):
                    s, t = shingles(x, n), shingles(y, n)
                    common = np.intersect1d(s, t, assume_unique=True).size
                    linked.append(100 * common >= percent * (s.size + t.size - common))
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return both.select("a", "b", "ta", "tb").mapInArrow(fresh(run), "a long, b long, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) of the nodes in edges (a, b), by alternating large and small stars."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.join(least, "a")
        if large:
            return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = materialize(edges.where("a <> b").distinct(), "links")
    before = mark(now)
    while before[0]:
        now = materialize(star(star(now, True), False).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def repeats(ids: DataFrame) -> bool:
    """Whether some doc_id that is not null has several rows."""
    return bool(ids.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1))


def numbered(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """df with kura_row, a number of its own for each row whose id is not null; written down, so that it stays."""
    return materialize(df.withColumn("kura_row", F.when(F.col(id_col).isNotNull(), F.monotonically_increasing_id())), "ngram-rows")


def join(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Rows that share a doc_id are linked by their own texts each."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if not repeats(docs):
        return join_unique(docs, "text", "doc_id", n, percent)
    held = numbered(docs)
    rows = join_unique(held, "text", "kura_row", n, percent).withColumnsRenamed({"doc_id": "kura_row", "component_id": "kura_part"})
    rows = rows.join(held.select("kura_row", "doc_id").where("kura_row is not null"), "kura_row", "left")
    least = rows.groupBy("kura_part").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "kura_part", "left").select("doc_id", "n_shingles", "component_id")


def join_unique(df: DataFrame, text_col: str, id_col: str, n: int, percent: int) -> DataFrame:
    """join for doc_ids that are null or of one row each."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = materialize(profile(docs, n, percent), "ngram-sets")
    counts = first.select(F.explode("prefix").alias("token")).groupBy("token").count()
    total = first.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    least = max(LEAST, -(-total // MOST_FREQUENT))  # so at most MOST_FREQUENT tokens
    heavy = np.sort(np.array([r[0] for r in counts.where(F.col("count") >= least).select("token").collect()], np.int64).view(np.uint64))
    rows = materialize(first.select("doc_id", "size", "key", "key2"), "ngram-rows")
    release(first)
    full = rows.where("doc_id is not null and size > 0")
    classes = materialize(full.groupBy("key", "key2").agg(F.min("doc_id").alias("doc_id"), F.min("size").alias("size")), "ngram-classes")
    every = profile(docs, n, percent, spark.sparkContext.broadcast(heavy))
    profiles = materialize(every.join(classes.select("doc_id"), "doc_id", "left_semi"), "ngram-profiles")  # a document of each class
    tidy(spark)
    tokens = dealt(profiles)
    members = materialize(blocks(tokens, percent).withColumn("component", F.lit(None).cast("long")), "ngram-blocks")
    hot = materialize(tokens.where("parts > 1").select("token", "parts", "key").distinct(), "ngram-hot-tokens")
    tidy(spark)
    links = linked_in(members, profiles, docs, n, percent)
    if hot.take(1):
        more = materialize(rest_blocks(hot, components(links)), "ngram-rest")
        links = links.union(linked_in(more, profiles, docs, n, percent))
    links = materialize(links, "ngram-links")
    release(profiles, members)
    tidy(spark)
    node = classes.select("key", "doc_id")
    edges = links.join(node.withColumnsRenamed({"key": "a", "doc_id": "x"}), "a").join(node.withColumnsRenamed({"key": "b", "doc_id": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    label = components(edges)
    named = classes.join(label, classes["doc_id"] == label["node"], "left").select("key", "key2", F.coalesce("component", "doc_id").alias("component"))
    return rows.withColumnRenamed("size", "n_shingles").join(named, ["key", "key2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def linked_in(members: DataFrame, profiles: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """linked_pairs of the members that may link, whose texts alone are read and sent."""
    few = materialize(sift(members, profiles, percent), "ngram-sifted")
    owned = materialize(profiles.select("doc_id", "key", "size").join(few.select("key").distinct(), "key"), "ngram-owned")
    texts = materialize(likely(docs, owned.select("doc_id"), n).join(owned, "doc_id").select("key", "size", "text", "prints"), "ngram-texts")
    tidy(members.sparkSession)
    links = linked_pairs(few, texts, n, percent)
    release(few, owned, texts)
    return links


def linked_pairs(members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b: links that connect in each block of members what any links connect. Each round tries pairs in the blocks where one failed."""
    links, tried, todo = None, None, members
    while True:
        pairs = materialize(candidates(todo, texts, tried, percent), "ngram-pairs")
        tidy(members.sparkSession)
        once = pairs.select("a", "b").distinct()
        ids = once.select(F.col("a").alias("key")).union(once.select(F.col("b").alias("key"))).distinct()
        checked = materialize(verify(once, texts.select("key", "text").join(ids, "key", "left_semi"), n, percent), "ngram-checked")
        found = checked.where("linked").select("a", "b")
        links = found if links is None else links.union(found)
        results = pairs.join(checked, ["a", "b"]).select("block", "a", "b", "linked")
        bad = results.where("not linked").select("block").distinct()
        if not bad.take(1):
            return links
        tried = materialize((results if tried is None else tried.unionByName(results)).join(bad, "block", "left_semi"), "ngram-tried")
        todo = materialize(todo.join(bad, "block", "left_semi"), "ngram-todo")

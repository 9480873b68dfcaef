"""Exact dedup: an extendible-hash index on shared files, in DataFrame functions only.

A text's key is the 64-bit hash of its normalised form. Keys of one row alone have nothing to compare; the index holds the
others. A bucket holds the keys that share a prefix of bits: keys are counted by prefix, a bucket over capacity splits on its
next bits and where a split passes the global depth the directory doubles, until none is over it. Texts go through the
directory to their bucket and buckets, which are key ranges, to owner tasks. In a bucket the texts of a key are a chain: each
is compared byte for byte with the one before, and equal ones become one link. Copies are combined by salt before they are
dealt to owners, so a group of any size sends SALTS texts at most. Owners write their buckets to the shared folder; rows look
their bucket, key and link up there.

Defined results: null texts count as empty, and empty texts are equal to each other; of rows with the same
doc_id and text each gives a row, and those of the largest doc_id are kept; null doc_ids are ordered first; a
group of null doc_ids alone keeps null; an empty table gives no rows; other columns aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that a bucket may hold before it splits, and most buckets wanted: past it the capacity grows, so that the directory
#: stays small enough to send to all tasks.
CAPACITY, MOST_BUCKETS = 20_000, 1 << 16
#: Bits of the first directory, and by which an overfull bucket's keys are counted anew.
FIRST_BITS, MORE_BITS = 12, 4
#: Partial entries of a text before its owner joins them.
SALTS = 8


def normal(text: Column) -> Column:
    """A-Z in lower case. lower() does just that where every character is a single byte."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def prefix(key: Column, bits: Column | int) -> Column:
    """The first bits of a key."""
    return F.call_function("shiftrightunsigned", key, F.lit(64) - bits)


def split(counts: dict[int, int], bits: int, deeper: int, capacity: int) -> tuple[list[tuple[int, int]], list[int]]:
    """From the number of keys by prefix of bits + deeper bits, below one prefix of bits each: the buckets (local depth, prefix) that
    doubling once and again settles, and the prefixes of all bits that are still over capacity."""
    done, over = [], []
    tops = {p >> deeper for p in counts}
    todo = [(bits, p) for p in tops]
    sums: dict[tuple[int, int], int] = {}
    for p, n in counts.items():
        for up in range(deeper + 1):
            at = (bits + deeper - up, p >> up)
            sums[at] = sums.get(at, 0) + n
    while todo:
        depth, p = todo.pop()
        if sums.get((depth, p), 0) <= capacity:
            done.append((depth, p))
        elif depth == bits + deeper:
            over.append(p)
        else:
            todo += [(depth + 1, 2 * p), (depth + 1, 2 * p + 1)]
    return done, over


def directory(spark: SparkSession, keys: DataFrame, capacity: int) -> list[tuple[int, int]]:
    """The buckets (local depth, prefix) of a table of distinct keys, in key order. At most some MOST_BUCKETS rows reach the driver."""
    counts = {r[0]: r[1] for r in keys.groupBy(prefix(F.col("key"), FIRST_BITS)).count().collect()}
    capacity = max(capacity, -(-sum(counts.values()) // MOST_BUCKETS))
    counts |= {p: 0 for p in range(1 << FIRST_BITS) if p not in counts}
    done, over = split(counts, 0, FIRST_BITS, capacity)
    bits = FIRST_BITS
    while over:
        full = F.broadcast(spark.createDataFrame([(p,) for p in over], "full long"))  # less than MOST_BUCKETS prefixes
        inside = keys.join(full, prefix(F.col("key"), bits) == F.col("full"))
        counts = {r[0]: r[1] for r in inside.groupBy(prefix(F.col("key"), bits + MORE_BITS)).count().collect()}
        found, over = split(counts, bits, MORE_BITS, capacity)
        done, bits = done + found, bits + MORE_BITS
    return sorted(done, key=lambda b: b[1] << (64 - b[0]))


def placed(df: DataFrame, buckets: list[tuple[int, int]]) -> DataFrame:
    """df with the bucket of its key: the one of its prefixes, of the depths that occur, that the directory has."""
    spark = df.sparkSession
    entries = spark.createDataFrame([(d, p, i) for i, (d, p) in enumerate(buckets)], "depth int, prefix long, bucket int")
    depths = sorted({d for d, _ in buckets})
    tries = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), (prefix(F.col("key"), d) if d else F.lit(0).cast("long")).alias("prefix")) for d in depths]))
    asked = df.withColumn("at", tries).withColumns({"depth": F.col("at.depth"), "prefix": F.col("at.prefix")})
    return asked.join(F.broadcast(entries), ["depth", "prefix"]).drop("at", "depth", "prefix")  # the directory: some MOST_BUCKETS rows


def index(df: DataFrame, text_col: str, id_col: str, capacity: int = CAPACITY) -> DataFrame:
    """The index, read back from shared files: bucket, key, link, text_sha256, keep_id, group_size of the texts whose key has several rows."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), normal(F.col(text_col)).alias("body")).withColumn("key", F.xxhash64("body"))
    keys = materialize(rows.groupBy("key").count().where("count > 1").select("key"), "dedup-keys")
    buckets = directory(spark, keys, capacity)
    copies = rows.join(keys, "key").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    combined = copies.groupBy("key", "body", "salt").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    owners = max(1, min(len(buckets), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    owned = placed(combined, buckets).repartitionByRange(owners, "bucket", "key").sortWithinPartitions("bucket", "key", "body")
    chain = Window.partitionBy("bucket", "key").orderBy("body")
    other = (~F.col("body").eqNullSafe(F.lag("body").over(chain))).cast("int")  # the bytes of the one before are not these
    linked = owned.withColumn("other", other).withColumn("link", F.sum("other").over(chain))
    links = linked.groupBy("bucket", "key", "link").agg(F.min(F.when(F.col("other") == 1, F.sha2("body", 256))).alias("text_sha256"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    out = materialize(links, "dedup-index")
    out.kura_buckets = buckets
    return out


def dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """One row for each row of df: id_col, keep_id, group_size, kept, text_sha256."""
    entries = index(df, text_col, id_col, **options)
    body = normal(F.col(text_col))
    rows = placed(df.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("key"), F.sha2(body, 256).alias("text_sha256")), entries.kura_buckets)
    found = rows.join(entries.drop("link"), ["bucket", "key", "text_sha256"], "left")
    many = F.coalesce("group_size", F.lit(1)).cast("long")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(F.col("id").alias(id_col), keep.alias("keep_id"), many.alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256")

"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates.

Features are the distinct words and word pairs of a text (lower-cased A-Z), hashed to 2**bits places; a score is
the logistic of a sparse dot product. One task trains on at most max_rows labelled documents. Their ids are chosen
first, from the labels alone: those of least hash of the doc_id. Only the texts of these ids, which are sent to the
scan, cross a shuffle. Weights have a fixed size (2**bits floats), so sending them to every worker is bounded.

Defined results: null and empty texts score the logistic of the bias; labels that are null or neither 0 nor 1 are
not learned from; repeated equal labels count once, and a document with both labels is learned with each; a chosen
label whose document is missing is one row less to learn from; of rows that share a doc_id the least text is learned; with no
labelled rows every score is 0.5; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, materialize, release, texts_of, with_columns

BITS = 20
MAX_ROWS = 10_000
FOLDS = 5
THRESHOLD = 0.3
ODD = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def word_hashes(words: list[bytes]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(w) for w in words]


MEMO = Memo(word_hashes)


def learn(texts: list[str]) -> None:
    MEMO.learn(t.encode().lower().split() for t in texts)


def features(text: str, bits: int) -> np.ndarray:
    """Places of the distinct words and word pairs."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.array(list(map(MEMO.learn([words]), words)), np.uint64)
    both = np.concatenate([h, (h[:-1] * ODD ^ h[1:]) * ODD])
    return np.unique(both >> np.uint64(64 - bits)).astype(np.int64)


def logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-min(35.0, max(-35.0, x)))))


class Ftrl:
    """Follow the regularised leader, proximal, with a rate for each coordinate; the bias is the last place."""

    def __init__(self, bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, places: np.ndarray, label: int) -> None:
        at = np.append(places, len(self.z) - 1)
        value = 1 / np.sqrt(max(1, places.size))
        w = self.weights(at)
        x = np.full(at.size, value)
        x[-1] = 1.0
        g = (logistic(float(w @ x)) - label) * x
        grown = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (grown - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def sample(labels: DataFrame, label_col: str = "label", id_col: str = "doc_id", max_rows: int = MAX_ROWS) -> DataFrame:
    """turn, id, label of at most max_rows labels, those of least hash of the id. A first cut at a hash that leaves little
    more than max_rows keeps what each task sends to the last one small, however many labels and tasks there are."""
    some = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.xxhash64(id_col, F.lit("train")).alias("turn"), F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    count = some.agg(F.approx_count_distinct("turn", 0.02)).first()[0]
    share = (1.2 * max_rows + 100) / max(1, count)
    if share < 1:
        some = some.where(F.col("turn") < int(share * (1 << 64)) - (1 << 63))
    return some.distinct().orderBy("turn", "id", "label").limit(max_rows)


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "label", id_col: str = "doc_id", bits: int = BITS, max_rows: int = MAX_ROWS, passes: int = 5, **options) -> np.ndarray:
    """Weights from at most max_rows labels and the texts of their documents; the bias is last."""
    chosen = materialize(sample(labels, label_col, id_col, max_rows), "classifier-sample")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")  # max_rows rows of three numbers
    some = rows.groupBy("turn", "id", "label").agg(F.min("text").alias("text")).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = [(turn, i, y, features(t, bits)) for b in batches for turn, i, y, t in zip(*(b[c].to_pylist() for c in ("turn", "id", "label", "text")), strict=True)]
        learned.sort(key=lambda r: r[:3])
        model = Ftrl(bits, **options)
        for _ in range(passes):
            for _, _, label, places in learned:
                model.update(places, label)
        w = model.weights(slice(None)).astype(np.float32)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["place", "weight"])

    found: pd.DataFrame = some.mapInArrow(run, "place long, weight float").toPandas()
    release(chosen)
    weights = np.zeros((1 << bits) + 1, np.float32)
    weights[found["place"].to_numpy(np.int64)] = found["weight"].to_numpy(np.float32)
    return weights


def score(df: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "score", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with score_col double."""
    bits = (len(weights) - 1).bit_length() - 1
    at = np.flatnonzero(weights).astype(np.int32)
    sent = df.sparkSession.sparkContext.broadcast((at, weights[at]))

    def make():
        w = np.zeros((1 << bits) + 1)
        w[sent.value[0]] = sent.value[1]

        def one(text: str) -> float:
            places = features(text, bits)
            return logistic(float(w[places].sum()) / np.sqrt(max(1, places.size)) + float(w[-1]))

        def fn(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = texts_of(batch, text_col)
            learn(texts)
            return [pa.array([one(t) for t in texts], pa.float64())]

        return fn

    return with_columns(df, text_col, [T.StructField(score_col, T.DoubleType())], make, drop)

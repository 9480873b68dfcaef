"""Quality rules: tokeniser fertility on top of plain text measures.

Two public vocabularies read every word: subword pieces with byte fallback, and byte-level merges. Natural prose of a language
has characters per token of either, a byte-fallback share and an entropy of its token distribution inside a band; junk
(symbol runs, random strings, one phrase over and over) falls outside. The bands are wide enough for ordinary prose of each
script; fit() raises the least characters a piece of a language to what all of a table's documents in it bear out. Language tags
are taken by their first part in any case (EN, en-US); texts of another or no tag take the band of their script.

Texts are read once: measure() gives the measures of each row, fit() the bands of a table of measures, judge() the verdicts.

Defined results: null and empty texts measure zero everywhere, have n_words 0 and so fail the base rule; equal
rows are measured alike and all kept or all rejected; existing columns of the outputs' names are replaced; an empty
table gives no rows and the wide bands.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import load_ranks
from .common import WHITE, Memo, materialize, one_at_a_time, texts_of, with_columns

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SYMBOLS = b"#*$%&|<>"
#: Shortest text in tokens whose entropy is judged; below it the measure says little.
ENTROPY_TOKENS = 50
#: Wide bands by script: least and most characters a piece, most byte-fallback share, least and most token entropy in bits, least and
#: most characters a byte-level token.
Band = tuple[float, float, float, float, float, float, float]
BANDS: dict[str, Band] = {"latin": (1.4, 6.0, 0.10, 3.0, 12.5, 1.0, 8.0), "other": (0.2, 6.0, 1.00, 2.0, 13.5, 0.1, 8.0)}
#: Languages in Latin script whose least characters a token is fitted, from so many documents on that pass the base rule.
FITTED, LEAST_ROWS = ("en", "de", "fr", "es"), 200
#: Distance of the fitted bound below the median, in distances from the lower quartile to the median.
QUARTILES = 7
#: Highest fitted bound: ordinary prose of the four languages has 2.8 to 4.5 characters a token.
HIGHEST_LOW = 2.5
LATIN = re.compile(r"[A-Za-zÀ-ɏ]")

FIELDS = [
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("n_tokens", T.LongType()),
    *(T.StructField(n, T.DoubleType()) for n in ("chars_per_token", "byte_share", "token_entropy", "chars_per_byte_token")),
    T.StructField("script", T.StringType()),
]


#: Numbers that stand before the piece ids of a word: its byte-level tokens, characters, letters of Latin script, letters.
HEAD = 4


@one_at_a_time
def words_of(path: str, byte_path: str) -> Memo:
    """From words to int32 strings of HEAD and piece ids."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(byte_path), special_tokens={})

    def learn(words: list[bytes]) -> list[bytes]:
        texts, out = [w.decode() for w in words], []
        for text, ids in zip(texts, model.encode(texts, num_threads=1), strict=True):
            head = (len(codec.encode_ordinary(text)), len(text), len(LATIN.findall(text)), sum(map(str.isalpha, text)))
            out.append(np.array([*head, *ids], np.int32).tobytes())
        return out

    return Memo(learn, 1 << 18)


@lru_cache(maxsize=2)
def byte_pieces(path: str) -> tuple[int, int]:
    """First and last id of the byte pieces, which are adjacent."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if model.is_byte(i)]
    return min(ids), max(ids)


def coded(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of some texts, the word at each place of all texts on end, and where each text begins and the last one ends."""
    words = pa.compute.ascii_split_whitespace(pa.compute.fill_null(texts, ""))
    one = words.flatten().dictionary_encode()
    distinct, at = one.dictionary.cast(pa.binary()).to_pylist(), one.indices.to_numpy()
    bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
    if b"" in distinct:  # beside white space at an end
        real = at != distinct.index(b"")
        bounds, at = np.concatenate([[0], np.cumsum(real)])[bounds], at[real]
    return distinct, at, bounds


def repeated_words(words: np.ndarray, many: int) -> int:
    """Words inside 3-word windows that occur twice or more; words has numbers below many."""
    n = words.size
    if n < 4:
        return 0
    if many**3 >= 1 << 62:
        distinct, words = np.unique(words, return_inverse=True)
        many = distinct.size
    words = words.astype(np.int64)
    pair = words[:-1] * many + words[1:]
    if many**3 >= 1 << 62:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * many + words[2:]
    order = np.argsort(window, kind="stable")
    same = np.flatnonzero(window[order[1:]] == window[order[:-1]])
    if not same.size:
        return 0
    starts = np.concatenate([order[same], order[same + 1]])
    hit = np.zeros(n, bool)
    for step in range(3):
        hit[starts + step] = True
    return int(hit.sum())


def base(raw: bytes) -> tuple[int, int]:
    """n_symbols, n_dup_lines."""
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    return len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines))


def entropy(ids: np.ndarray) -> float:
    """Bits a token."""
    counts = np.bincount(ids)
    p = counts[counts > 0] / max(1, ids.size)
    return max(0.0, float(-(p * np.log2(p)).sum()))


def measure(df: DataFrame, text_col: str = "text", path: str = VOCABULARY, byte_path: str = BYTE_VOCABULARY, min_words: int = 50, max_repeat_percent: int = 50, drop: tuple[str, ...] = ()) -> DataFrame:
    """df with FIELDS."""

    def make():
        memo, bytes_at = words_of(path, byte_path), byte_pieces(path)

        def fn(batch: pa.RecordBatch) -> list[pa.Array]:
            distinct, at, bounds = coded(batch[text_col])
            found = list(map(memo.learn([distinct]), distinct))
            ids = np.frombuffer(b"".join(found), np.int32)
            ends = np.cumsum([len(f) // 4 for f in found], dtype=np.int64)
            starts = np.concatenate([[0], ends])[:-1] + HEAD
            fallback_to = np.concatenate([[0], np.cumsum((ids >= bytes_at[0]) & (ids <= bytes_at[1]))])
            heads = ids[starts[:, None] + np.arange(-HEAD, 0)] if found else np.zeros((0, HEAD))
            table = np.column_stack([heads, ends - starts, fallback_to[ends] - fallback_to[starts]]).astype(np.int64)
            sums = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(table[at], axis=0)])[bounds]
            rows = []
            for text, a, b, (pieces_b, chars, latin, letters, tokens, fallback) in zip(texts_of(batch, text_col), bounds, bounds[1:], np.diff(sums, axis=0).tolist(), strict=False):
                own = at[a:b]
                repeat = repeated_words(own, len(distinct))
                many = ends[own] - starts[own]
                past = np.cumsum(many)
                spread = entropy(ids[np.repeat(starts[own] - past + many, many) + np.arange(tokens)])
                symbols, dup_lines = base(text.encode())
                n = int(b - a)
                rows.append((n, chars, symbols, dup_lines, repeat, n < min_words or 100 * repeat > max_repeat_percent * n, tokens, chars / max(1, tokens), fallback / max(1, tokens), spread, chars / max(1, pieces_b), "latin" if 2 * latin >= letters else "other"))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64()] + [pa.float64()] * 4 + [pa.string()]
            return [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]

        return fn

    return with_columns(df, text_col, FIELDS, make, drop)


def language(lang: Column) -> Column:
    """The language of a tag: its first part, in lower case."""
    return F.split(F.lower(F.trim(lang)), "[-_]")[0]


def judge(measured: DataFrame, bands: dict[str, Band] = BANDS, lang_col: str = "lang") -> DataFrame:
    """measured with kept: not base_failed, and inside the band of the language, else of the script of most letters."""
    own = language(F.col(lang_col)) if lang_col in measured.columns else F.lit(None).cast("string")

    def bound(i: int) -> Column:
        table = F.create_map(*[F.lit(x) for k, b in bands.items() for x in (k, float(b[i]))])
        return F.coalesce(F.try_element_at(table, own), F.try_element_at(table, F.col("script")))

    good = (
        F.col("chars_per_token").between(bound(0), bound(1)) & (F.col("byte_share") <= bound(2)) & F.col("chars_per_byte_token").between(bound(5), bound(6))
        & ((F.col("n_tokens") < ENTROPY_TOKENS) | F.col("token_entropy").between(bound(3), bound(4)))
    )
    return measured.withColumn("kept", good & ~F.col("base_failed"))


def fit(measured: DataFrame, lang_col: str = "lang") -> dict[str, Band]:
    """BANDS and a band for each of FITTED, from all rows of a table of measures that pass the base rule. A text in Latin script without
    such a language is held to the least of the fitted bounds. Counts are exact and in hundredths, so equal tables give equal bands."""
    if lang_col not in measured.columns:
        return BANDS
    counts = measured.where("not base_failed").groupBy(language(F.col(lang_col)).alias("own"), F.floor(F.col("chars_per_token") * 100).alias("bin")).count().where(F.col("own").isin(*FITTED))
    bins: dict[str, list[tuple[int, int]]] = {}
    for r in counts.collect():  # a row for each language and hundredth
        bins.setdefault(r["own"], []).append((r["bin"], r["count"]))
    wide, out = BANDS["latin"], {}
    for lang, some in bins.items():
        values, sizes = np.array(sorted(some)).T
        total = sizes.cumsum()
        if total[-1] >= LEAST_ROWS:
            quarter, half = (quantile(values, sizes, total, q) for q in (0.25, 0.5))
            out[lang] = (round(min(HIGHEST_LOW, max(wide[0], half - QUARTILES * (half - quarter))), 4), *wide[1:])
    least = min((b[0] for b in out.values()), default=wide[0])
    return BANDS | {"latin": (least, *wide[1:])} | out


def quantile(values: np.ndarray, sizes: np.ndarray, total: np.ndarray, q: float) -> float:
    """The q-quantile of counted hundredths, in line between the ends of its bin."""
    at = int(np.searchsorted(total, q * total[-1]))
    return (float(values[at]) + float(q * total[-1] - total[at] + sizes[at]) / float(sizes[at])) / 100


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang", bands: dict[str, Band] | None = None, **options) -> DataFrame:
    """The rows whose verdict by df's own bands is kept, with df's own columns only."""
    held = "kura_input"
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(held), *[F.col(f"`{c}`") for c in (text_col, lang_col) if c in df.columns])
    measured = materialize(measure(whole, text_col, drop=(text_col,), **options), "quality")
    return judge(measured, bands or fit(measured, lang_col), lang_col).where("kept").select(f"{held}.*")

"""Quality rules: word and line rules, and the fertility of a public tokeniser."""

from __future__ import annotations

import functools
import math
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, slices
from .vocabulary import MULTI, PIECES, known_characters, tiktoken_encoding

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
MIN_WORDS, MAX_REPEATED = 10, 20  # words; percent of words in repeated windows
WINDOW = 5

#: Bands of each script: least and most characters per token, most byte-fallback share, least
#: token entropy as a share of what its token count allows. Texts outside are rejected.
BANDS: dict[str, tuple[float, float, float, float]] = {
    "LATIN": (1.85, 8.0, 0.20, 0.45),
    "CYRILLIC": (1.0, 8.0, 0.20, 0.45),
    "GREEK": (0.8, 8.0, 0.25, 0.45),
    "ARABIC": (0.8, 8.0, 0.25, 0.45),
    "HEBREW": (0.5, 8.0, 0.25, 0.45),
    "CJK": (0.3, 4.0, 0.60, 0.45),
    "": (0.3, 8.0, 0.60, 0.45),
}
#: Fertility and entropy say less about fewer tokens: their bands widen by 1 + (SLACK / tokens) ** 2.
SLACK = 16


@functools.lru_cache(1 << 16)
def script(c: str) -> str:
    """The script of a letter as its Unicode name says; empty for scripts without a band."""
    name = unicodedata.name(c, "").split(" ")[0].split("-")[0]
    name = "CJK" if name in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL") else name
    return name if name in BANDS else ""


def base_rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()  # bytes.split() splits at exactly 0x20 and 0x09 to 0x0D
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    repeated = 0
    if n >= WINDOW:
        grams = list(zip(*[words[i:] for i in range(WINDOW)], strict=False))
        if len(set(grams)) < len(grams):
            ids: dict[tuple, int] = {}
            at = np.fromiter([ids.setdefault(g, len(ids)) for g in grams], np.int64, len(grams))
            twice = np.flatnonzero(np.bincount(at)[at] > 1)
            covered = np.zeros(n + 1, np.int32)
            np.add.at(covered, twice, 1)
            np.add.at(covered, twice + WINDOW, -1)
            repeated = int((np.cumsum(covered[:n]) > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def fertility(text: str, encoding, known: frozenset[str]) -> tuple[str, int, float, float, float]:
    """Script, tokens, characters per token, byte-fallback share, relative token entropy."""
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    n = len(ids)
    letters: dict[str, int] = {}
    fallback = 0
    for c in set(text):
        if c.isalpha() or (c not in known and c not in SPACES):
            k = text.count(c)
            if c.isalpha():
                letters[s] = letters.get(s := script(c), 0) + k
            if c not in known and c not in SPACES:
                fallback += k * len(c.encode())
    main = max(letters, key=lambda s: (letters[s], s), default="")
    if not n:
        return main, 0, 0.0, 0.0, 0.0
    counts = np.bincount(np.unique(ids, return_inverse=True)[1])
    entropy = float(-(counts / n * np.log2(counts / n)).sum()) / math.log2(n) if n > 1 else 1.0
    return main, n, len(text) / n, fallback / max(1, len(text.encode())), entropy


def in_band(measured: tuple[str, int, float, float, float], bands=BANDS) -> bool:
    """Is a text inside its script's band? One rule for every number of tokens."""
    main, n, per_token, fallback, entropy = measured
    low, high, most, least = bands[main]
    wide = 1 + (SLACK / max(n, 1)) ** 2
    return n > 0 and fallback <= most and low <= per_token * wide and per_token <= high * wide and least <= entropy * wide


def measure(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = MULTI, pieces: str = PIECES, bands=BANDS) -> DataFrame:
    """The rules' measures and verdicts for every whole text, in one pass without a shuffle.

    Columns: ``doc_id``, the base (``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed``), the method's (``script, n_tokens, chars_per_token,
    fallback_share, token_entropy``) and ``kept``. A null or empty text has no words and fails.
    Every row is judged by itself, by its whole text of any length: ids may be null or repeat, and
    repeated rows have one verdict. An empty table gives an empty result. Other columns, whatever
    their names, are ignored.
    """
    kind = df.schema[doc_id].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "script", "n_tokens", "chars_per_token", "fallback_share", "token_entropy", "kept"]
    kinds = [*[pa.int64()] * 5, pa.bool_(), pa.string(), pa.int64(), *[pa.float64()] * 3, pa.bool_()]

    def run(batches):
        encoding, known = tiktoken_encoding(path), known_characters(pieces)
        for b in slices(batches):
            rows = []
            for t in b.column("text").to_pylist():
                base = base_rules(t or "")
                failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEATED * base[0]
                m = fertility(t or "", encoding, known)
                rows.append((*base, failed, *m, not failed and in_band(m, bands)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", *names])

    return only(df, doc_id=doc_id, text=text).mapInArrow(
        run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, n_tokens long, chars_per_token double, fallback_share double, token_entropy double, kept boolean"
    )


def keep(df: DataFrame, text: str = "text", path: str = MULTI, pieces: str = PIECES, bands=BANDS) -> DataFrame:
    """The rows of ``df`` that :func:`measure` keeps, with all their columns, as they are, whatever
    their names; repeated rows stay or go together."""

    def run(batches):
        encoding, known = tiktoken_encoding(path), known_characters(pieces)
        for b in slices(batches, text):
            mask = []
            for t in b.column(b.schema.names.index(text)).to_pylist():
                base = base_rules(t or "")
                mask.append(base[0] >= MIN_WORDS and 100 * base[4] <= MAX_REPEATED * base[0] and in_band(fertility(t or "", encoding, known), bands))
            yield b.filter(pa.array(mask, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def fit_bands(measured: DataFrame, low: float = 0.0005, high: float = 0.9995, bands=BANDS) -> dict[str, tuple[float, float, float, float]]:
    """Bands that a corpus itself suggests, for :func:`measure` and :func:`keep`: quantiles of the
    measures over all texts that pass the base rules, for each script (sketches are merged, and
    the driver gets a row for each script). Scripts that the corpus lacks keep their band."""
    of = measured.where(~F.col("base_failed")).groupBy("script")
    rows = of.agg(
        F.percentile_approx("chars_per_token", [low, high], 10_000).alias("chars"),
        F.percentile_approx("fallback_share", high, 10_000).alias("fallback"),
        F.percentile_approx("token_entropy", low, 10_000).alias("entropy"),
    )
    return {**bands, **{r.script: (*r.chars, r.fallback, r.entropy) for r in rows.collect()}}


def op9(spark, sf_dir: str) -> DataFrame:
    """Every document's measures and verdict."""
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def quality_base(spark, sf_dir: str) -> DataFrame:
    """The part of :func:`op9` that SQL can express."""
    return op9(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")

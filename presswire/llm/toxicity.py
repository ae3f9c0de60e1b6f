"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a sentence's score is a logistic function of its words'
character n-grams, and the document's is the leaky noisy-or of its sentences: it is toxic unless
all of them and the leak, one chance for each document whatever its length, are clean. A sentence
without any evidence adds nothing. Only documents have labels, and their likelihood trains the
sentence scores. The same scores then locate the offending sentences.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, slices, text_hash, written

THRESHOLD = 0.3
#: Labelled documents that the model is fitted on at most, drawn by a hash of their id.
MAX_TRAIN = 8_000
#: Sentences that have a feature at least, and the G statistic of its association with the label.
MIN_SENTENCES, MIN_ASSOCIATION = 3, 15.0
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"\w+")
#: Words that a Python worker remembers with their scores, and words that fitting remembers.
REMEMBERED, FITTING = 250_000, 60_000
#: Longer words (unspaced stretches) are not remembered but worked out each time.
LONG = 40


def grams(word: str) -> set[str]:
    """Features of a lower-cased word: itself, its beginnings, and its character n-grams (4, 5)."""
    w = f"^{word}$"
    n = len(w)
    return {w, w[:4], w[:5], w[:6], w[:7], *[w[i : i + 4] for i in range(n - 3)], *[w[i : i + 5] for i in range(n - 4)]}


def _hash(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass"))


class _Scores(dict):
    """Scores of words, worked out on first use."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        found = self.weights.keys() & grams(word)
        s = sum([self.weights[g] for g in sorted(found)]) if found else 0.0
        if len(word) <= LONG:
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = s
        return s


@dataclass
class Model:
    leak: float  # log odds
    bias: float
    weights: dict[str, float]

    def scorer(self):
        """text to its score and its sentences with evidence: (start, end, score)."""
        of, clean = _Scores(self.weights), -np.logaddexp(0, self.leak)

        def score(text: str) -> tuple[float, list[tuple[int, int, float]]]:
            if not any(map(of.__getitem__, set(WORD.findall(text.lower())))):
                return float(-np.expm1(clean)), []
            log_clean, found = clean, []
            for m in SENTENCE.finditer(text):
                s = sum(map(of.__getitem__, WORD.findall(m[0].lower())))
                if s:
                    one = -np.logaddexp(0, self.bias + s)
                    found.append((m.start(), m.end(), float(-np.expm1(one))))
                    log_clean += one
            return float(-np.expm1(log_clean)), found

        return score


def sentences_of(texts: list[str], toxic: list[int]) -> dict[str, tuple[int, set[int]]]:
    """The different sentences of ``texts`` (lower case), each with 0 if a clean text has it and
    else 1 (of a clean bag nothing is toxic), and the different pairs of sentences that it stands
    between: a sentence in copies of one text is one piece of evidence, in other texts it is more."""
    out: dict[str, tuple[int, set[int]]] = {}
    for t, y in zip(texts, toxic, strict=True):
        found = [s for m in SENTENCE.finditer(t.lower()) if (s := m[0].strip())]
        for before, s, after in zip(["", *found], found, [*found[1:], ""], strict=False):
            label, places = out.get(s, (1, set()))
            places.add(_hash(f"{before}\n{after}"))
            out[s] = min(label, int(y != 0)), places
    return out


def counted(sentences: list[str], toxic: list[int], times: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (hashes) of sentences, and how often toxic and other ones have each."""
    known: dict[str, np.ndarray] = {}

    def of(word: str) -> np.ndarray:
        if (f := known.get(word)) is None:
            f = np.array([_hash(g) for g in grams(word)], np.int64)
            if len(word) <= LONG:
                if len(known) > FITTING:
                    known.clear()
                known[word] = f
        return f

    each = [np.unique(np.concatenate([of(w) for w in words])) if (words := set(WORD.findall(s))) else np.zeros(0, np.int64) for s in sentences]
    features, at = np.unique(np.concatenate([np.zeros(0, np.int64), *each]), return_inverse=True)
    owner = np.repeat(np.arange(len(each)), [len(f) for f in each])
    times, label = np.asarray(times, np.float64), np.asarray(toxic, np.float64)
    total = np.bincount(at, times[owner], len(features))
    with_ = np.bincount(at, (times * label)[owner], len(features))
    return features, with_.astype(np.int64), (total - with_).astype(np.int64)


def associated(with_: np.ndarray, without: np.ndarray, base: float) -> np.ndarray:
    """Which features speak for toxicity, by the numbers of :func:`counted` and the share of the label."""
    with_, without = with_.astype(np.float64), without.astype(np.float64)
    share = np.clip(with_ / np.maximum(with_ + without, 1), 1e-9, 1 - 1e-9)
    g = 2 * (with_ * np.log(share / base) + without * np.log((1 - share) / (1 - base)))
    return (with_ + without >= MIN_SENTENCES) & (share > base) & ((share >= 3 * base) | (share >= 0.5)) & (g >= MIN_ASSOCIATION)


def evidence(texts: list[str], index: dict[int, int]) -> tuple[list[list[list[int]]], dict[str, int]]:
    """For each text the features (numbers of ``index``) of each of its sentences that has any, one
    for every word that has it; and the strings behind the features."""
    picked: dict[str, list[int]] = {}
    named: dict[str, int] = {}

    def of(word: str) -> list[int]:
        if (own := picked.get(word)) is None:
            found = {g: i for g in grams(word) if (i := index.get(_hash(g))) is not None}
            named.update(found)
            own = sorted(set(found.values()))
            if len(word) <= LONG:
                if len(picked) > FITTING:
                    picked.clear()
                picked[word] = own
        return own

    out = []
    for t in texts:
        sentences = ([i for w in WORD.findall(m[0].lower()) for i in of(w)] for m in SENTENCE.finditer(t))
        out.append([own for own in sentences if own])
    return out, named


def base_share(toxic: int, n: int) -> float:
    return float(np.clip(toxic / n if n else 0.0, 1e-4, 1 - 1e-4))


def solve(sentences: list[list[list[int]]], toxic: list[int], n_clean: int, named: dict[str, int], steps: int = 400, rate: float = 0.1, penalty: float = 2e-4) -> Model:
    """Maximum likelihood of document labels under the noisy-or, by Adam. ``sentences`` and
    ``toxic`` are of the documents that are toxic or have evidence; ``n_clean`` others are clean and
    have none. Without features, or without both labels, the leak alone fits the share of toxic ones."""
    y = np.asarray([*toxic, 0], np.float64)
    weight = np.append(np.ones(len(toxic)), n_clean)
    n, m = weight.sum(), 1 + max(named.values(), default=-1)
    base = base_share(y.sum(), n)
    rows_doc = np.array([d for d, own in enumerate(sentences) for _ in own], np.int64)
    cell_row = np.repeat(np.arange(len(rows_doc)), [len(s) for own in sentences for s in own])
    cell_f = np.array([i for own in sentences for s in own for i in s], np.int64)
    w, b = np.zeros(m), float(np.log(base / max(1, len(rows_doc) / max(n, 1))))
    leak = float(np.log(base / (1 - base)))
    m1, m2 = np.zeros(len(w) + 2), np.zeros(len(w) + 2)
    for step in range(1, steps + 1 if n else 1):
        z = b + np.bincount(cell_row, w[cell_f], len(rows_doc))
        p, p0 = np.exp(-np.logaddexp(0, -z)), np.exp(-np.logaddexp(0, -leak))
        log_clean = -np.logaddexp(0, leak) - np.bincount(rows_doc, np.logaddexp(0, z), len(y))
        clean = np.exp(np.minimum(log_clean, -1e-9))
        up = np.where(y > 0, clean / (1 - clean), -1.0) * weight  # d loglik / d (-log_clean)
        grow = up[rows_doc] * p
        grad = np.append(np.bincount(cell_f, grow[cell_row], len(w)) / n - penalty * w, [grow.sum() / n, up.sum() * p0 / n])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, b, leak = w + move[:-2], b + move[-2], leak + move[-1]
    return Model(float(leak), float(b), {g: float(w[i]) for g, i in sorted(named.items()) if abs(w[i]) > 1e-6})


def fit(texts: list[str], toxic: list[int]) -> Model:
    """The model of a few texts in memory; :func:`train` does the same over tables."""
    of = sentences_of(texts, toxic)
    label, times = [y for y, _ in of.values()], [len(p) for _, p in of.values()]
    features, with_, without = counted(list(of), label, times)
    base = base_share(sum(y * k for y, k in zip(label, times, strict=True)), sum(times))
    index = {int(f): i for i, f in enumerate(features[associated(with_, without, base)])}
    sentences, named = evidence(texts, index)
    return solve(sentences, toxic, 0, named)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most ``max_train`` labelled documents (``docs``: doc_id, text; ``labels``:
    doc_id, toxic) whose ids are not held out. Null ids, null labels and null texts teach nothing;
    of texts with one id the one with the smallest hash does, and an id labelled twice is toxic if
    any label says so; without labelled documents nothing is toxic. Texts stay on the executors:
    the driver gets the features that speak for toxicity and the sentences that have them."""
    y = only(labels, doc_id="doc_id", toxic="toxic").select("doc_id", F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y is not null")
    y = y.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    drawn = y.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(max_train)  # so many rows are broadcast
    own = only(docs, doc_id="doc_id", text="text").where("text is not null").join(F.broadcast(drawn), "doc_id")
    sample = written(own.groupBy("doc_id").agg(F.min_by("text", F.struct(text_hash(), F.col("text"))).alias("text"), F.max("y").alias("y")).select("text", "y"))
    n = sample.count()
    spread = sample.repartition(max(8, min(64, n // 64)))  # the work is in the texts, not in their number

    def split(batches):
        for b in batches:
            found = sentences_of(b.column("text").to_pylist(), b.column("y").to_pylist())
            rows = [(s, y, p) for s, (y, places) in found.items() for p in places]
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64()), strict=True)], ["sentence", "y", "place"])

    def count(batches):
        for b in batches:
            columns = counted(*(b.column(c).to_pylist() for c in ("sentence", "y", "times")))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["f", "w", "o"])

    places = spread.mapInArrow(split, "sentence string, y int, place long").groupBy("sentence", "place").agg(F.min("y").alias("y"))
    different = written(places.groupBy("sentence").agg(F.min("y").alias("y"), F.count(F.lit(1)).alias("times")))
    all_, toxic = different.agg(F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.sum(F.col("y") * F.col("times")), F.lit(0))).first()
    base = base_share(toxic, all_)

    def choose(batches):
        for b in batches:
            yield b.filter(pa.array(associated(b.column("w").to_numpy(), b.column("o").to_numpy(), base), pa.bool_()))

    sums = different.repartition(max(8, min(64, all_ // 2048))).mapInArrow(count, "f long, w long, o long").groupBy("f").agg(F.sum("w").alias("w"), F.sum("o").alias("o"))
    chosen = sums.where(F.col("w") + F.col("o") >= MIN_SENTENCES).mapInArrow(choose, "f long, w long, o long").select("f").toArrow().column("f").to_pylist()
    index = {f: i for i, f in enumerate(sorted(chosen))}

    def collect(batches):
        for b in batches:
            found, named = evidence(b.column("text").to_pylist(), index)
            label = [int(x != 0) for x in b.column("y").to_pylist()]
            use = [k for k, own in enumerate(found) if own or label[k]]
            names = list(named.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([*[found[k] for k in use], None], pa.list_(pa.list_(pa.int32()))), pa.array([*[label[k] for k in use], None], pa.int32()), pa.array([*[None] * len(use), [g for g, _ in names]], pa.list_(pa.string())), pa.array([*[None] * len(use), [i for _, i in names]], pa.list_(pa.int32()))],
                ["sentences", "y", "grams", "numbers"],
            )

    rows = spread.mapInArrow(collect, "sentences array<array<int>>, y int, grams array<string>, numbers array<int>").toArrow().to_pylist()
    named = {g: i for r in rows if r["y"] is None for g, i in zip(r["grams"], r["numbers"], strict=True)}
    own = sorted((r["y"], r["sentences"]) for r in rows if r["y"] is not None)
    return solve([s for _, s in own], [t for t, _ in own], n - len(own), named)


def held_out(column: str):
    """crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, n_offending, offending`` for every whole text, in one pass without a
    shuffle; ``offending`` lists (start, end, score) of the sentences that score THRESHOLD or
    more. Texts without evidence, null and empty ones too, score what the leak alone gives. Rows
    are scored one by one, whole texts of any length; ids may be null or repeat, and an empty
    table gives an empty result. Other columns, whatever their names, are ignored."""
    kind = docs.schema[doc_id].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        of = model.scorer()
        for b in slices(batches):
            got = [of(t or "") for t in b.column("text").to_pylist()]
            bad = [[{"start": s, "end": e, "score": p} for s, e, p in found if p >= THRESHOLD] for _, found in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[0] for g in got], pa.float64()), pa.array([len(x) for x in bad], pa.int64()), pa.array(bad, spans)], ["doc_id", "score", "n_offending", "offending"])

    return only(docs, doc_id=doc_id, text=text).mapInArrow(run, f"doc_id {kind}, score double, n_offending long, offending array<struct<start:int,end:int,score:double>>")


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below THRESHOLD, with all their columns, as :func:`score`
    scores them: null and empty texts stay, repeated rows stay or go together."""

    def run(batches):
        of = model.scorer()
        for b in slices(batches, text):
            yield b.filter(pa.array([of(t or "")[0] < THRESHOLD for t in b.column(b.schema.names.index(text)).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3(spark, sf_dir: str) -> DataFrame:
    """Every document's score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_offending")

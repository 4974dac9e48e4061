"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence is a bag of hashed words and stems with a logistic score; a document is toxic when at least
one sentence is, so its score is the noisy-or of its sentences' scores. Weights are fitted to
document labels alone, through the noisy-or. The same sentence scores then tell where in a
document the offence is.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridscope.llm.common import column_of, crc_share, slices, staged

#: Hashed words, and the words whose hash a worker remembers.
BUCKETS, CACHE_WORDS = 1 << 18, 1_000_000
#: A word also counts by its first letters, as compounds and inflected forms share a stem.
STEMS = (3, 5, 7)
#: Documents at this score or above are told toxic, and sentences offending.
THRESHOLD = 0.3
#: A sentence ends at one of these marks; anything between two of them is one.
SENTENCE = re.compile(r"[^.!?\n\r…。！？।؟]+")
#: Words are runs of letters and digits of any script.
WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class ToxicityModel:
    """A weight per hashed word (``BUCKETS`` of them, as 32-bit numbers) and a bias."""

    weights: np.ndarray
    bias: float


def buckets_of(word: str) -> list[int]:
    """Buckets of a lower-cased word: its own, and those of the stems it starts with."""
    parts = ["=" + word, *(word[:size] for size in STEMS if len(word) > size)]
    return [zlib.crc32(p.encode("utf-8", "replace")) % BUCKETS for p in parts]


class Remembered(dict):
    """What ``make`` gives for a word; forgets all words when there are too many."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= CACHE_WORDS:
            self.clear()
        made = self[word] = self.make(word)
        return made


def instances(text: str) -> tuple[list[str], list[int], list[tuple[int, int]]]:
    """Lower-cased words of a text, where each sentence starts among them, and the sentences' spans.

    Sentences without a word are left out. A word counts once per sentence and occurrence.
    """
    words, starts, spans = [], [], []
    for match in SENTENCE.finditer(text):
        found = WORD.findall(match.group().lower())
        if found:
            starts.append(len(words))
            words += found
            spans.append(match.span())
    return words, starts, spans


def log_clean(scores: np.ndarray) -> np.ndarray:
    """Logarithm of one minus the logistic of ``scores``."""
    return -np.logaddexp(0.0, scores)


def logistic(scores: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -scores))


def noisy_or(scores: np.ndarray) -> float:
    """The chance that one sentence at least is toxic; none for no sentence."""
    return float(-np.expm1(log_clean(scores).sum())) if len(scores) else 0.0


def fit_weights(
    words: list[np.ndarray], starts: list[np.ndarray], labels: np.ndarray, rounds: int = 150, rate: float = 0.1, shrink: float = 0.3, least: int = 5,
) -> ToxicityModel:
    """Weights that make the noisy-or of each bag's sentences agree with its label.

    ``words`` are the buckets of each bag, ``starts`` where its sentences begin. Gradient steps
    of adaptive size on the likelihood of the labels; absolute values of weights are pulled to
    zero by ``shrink`` documents, so that buckets that tell nothing keep none, nor do those that
    fewer than ``least`` bags hold.
    """
    labels = np.asarray(labels, float)
    flat = np.concatenate(words)
    counts = np.array([len(s) for s in starts])
    bags = np.concatenate([[0], np.cumsum(counts)[:-1]])
    of_bag = np.repeat(np.arange(len(counts)), counts)
    sentences = np.concatenate([s + at for s, at in zip(starts, np.cumsum([0, *map(len, words[:-1])]), strict=True)])
    of_sentence = np.repeat(np.arange(len(sentences)), np.diff(np.append(sentences, len(flat))))
    held = np.bincount(np.unique(flat.astype(np.int64) * len(counts) + of_bag[of_sentence]) // len(counts), minlength=BUCKETS)
    known = held[flat] >= least
    used, place = np.unique(flat[known], return_inverse=True)
    of_sentence = of_sentence[known]
    shrink /= len(labels)
    share = min(max(labels.mean(), 1e-4), 1 - 1e-4)
    weights, bias = np.zeros(len(used)), float(np.log(share / max(counts.mean(), 1.0)))
    first, second, bias_first, bias_second = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for k in range(1, rounds + 1):
        scores = np.bincount(of_sentence, weights=weights[place], minlength=len(sentences)) + bias
        chance = logistic(scores)
        clean = np.add.reduceat(log_clean(scores), bags)
        none = np.exp(clean)
        pull = np.where(labels > 0, none / np.maximum(-np.expm1(clean), 1e-12), -1.0)  # of each bag, per unit of a sentence's chance
        slope = pull[of_bag] * chance / len(labels)
        slopes = np.bincount(place, weights=slope[of_sentence], minlength=len(used))
        first, second = 0.9 * first + 0.1 * slopes, 0.99 * second + 0.01 * slopes**2
        bias_first, bias_second = 0.9 * bias_first + 0.1 * slope.sum(), 0.99 * bias_second + 0.01 * slope.sum() ** 2
        size = rate / (1 + 2 * k / rounds)
        even, square = 1 - 0.9**k, 1 - 0.99**k
        step = size / (np.sqrt(second / square) + 1e-5)
        weights += step * first / even
        weights = np.sign(weights) * np.maximum(0.0, np.abs(weights) - step * shrink)
        bias += 0.2 * size * bias_first / even / (np.sqrt(bias_second / square) + 1e-5)
    full = np.zeros(BUCKETS, np.float32)
    full[used] = weights
    return ToxicityModel(full, float(bias))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buckets = Remembered(buckets_of)
    for batch in slices(batches, "text"):
        words, starts = [], []
        for text in column_of(batch, "text"):
            found, begins, _ = instances(text)
            each = [buckets[w] for w in found]
            before = np.cumsum([0, *map(len, each)])
            words.append(np.array([b for held in each for b in held], np.int32).tobytes())
            starts.append(before[begins].astype(np.int64).tobytes())
        yield pa.RecordBatch.from_pydict({
            "draw": batch.column(batch.schema.get_field_index("draw")), "label": batch.column(batch.schema.get_field_index("label")),
            "words": pa.array(words, pa.binary()), "starts": pa.array(starts, pa.binary()),
        })


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
    sample_rows: int = 6_000, sample_bytes: int = 24 << 20,
) -> ToxicityModel:
    """Learn from the rows of ``docs`` where ``learn`` holds that ``labels`` (``key, label``) marks with 0 or 1.

    Rows without key, label or words teach nothing. A row labelled more than once takes its
    highest label. Learning uses a bounded sample: at most ``sample_rows`` rows and about
    ``sample_bytes`` bytes of text (one row at least), drawn by a hash of key and text; where
    there are fewer rows, all are used. Without both labels among them every score is the
    share of label 1.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max(F.col(label).cast("int")).alias("label")
    )
    draw = F.xxhash64(F.col(key), F.col(text), F.lit("toxicity sample"))
    rows = docs.where(learn & F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("key"), draw.alias("draw"), F.col(text).cast("string").alias("text"))
    sizes = rows.select("key", "draw", F.octet_length("text").alias("size")).join(marks, "key").orderBy("draw", "size").select("draw", "size")
    held, cut = 0, None
    for r in sizes.limit(sample_rows).collect():  # a bounded sample: two numbers a row
        held += r["size"]
        if cut is not None and held > sample_bytes:
            break
        cut = r["draw"]
    if cut is None:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), -30.0)
    chosen = staged(
        rows.where(F.col("draw") <= cut).join(marks, "key").select("draw", "label", "text").orderBy("draw").limit(sample_rows)
        .mapInArrow(_features, "draw long, label int, words binary, starts binary"), "toxicity-sample",
    )

    def learned(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["draw", "label", "words"], kind="stable")
        words = [np.frombuffer(w, np.int32) for w in group["words"]]
        starts = [np.frombuffer(s, np.int64) for s in group["starts"]]
        full = [k for k, s in enumerate(starts) if len(s)]
        marked = (group["label"].to_numpy() > 0)[full]
        if not full or marked.all() or not marked.any():
            share = min(max(float(marked.mean()) if full else 0.0, 1e-9), 1 - 1e-9)
            model = ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
        else:
            model = fit_weights([words[k] for k in full], [starts[k] for k in full], marked)
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    found = chosen.groupBy(F.lit("all")).applyInPandas(learned, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else ToxicityModel(np.zeros(BUCKETS, np.float32), -30.0)


def word_weights(model: ToxicityModel) -> Remembered:
    """Weight of a word, from all its buckets."""
    return Remembered(lambda word: float(model.weights[buckets_of(word)].sum()))


def judged(text: str | None, bias: float, weights: Remembered, threshold: float) -> tuple[float, list[dict]]:
    """Score of a text, and its offending sentences with their place in it, in code points."""
    words, starts, spans = instances(text or "")
    if not words:
        return 0.0, []
    scores = np.add.reduceat(np.fromiter(map(weights.__getitem__, words), float, len(words)), starts) + bias
    chances = logistic(scores)
    where = np.flatnonzero(chances >= threshold)
    return noisy_or(scores), [{"start": spans[k][0], "length": spans[k][1] - spans[k][0], "score": float(chances[k])} for k in where.tolist()]


SENTENCES = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: ``key, score, predicted`` and ``sentences``, the offending ones as ``start, length, score``.

    ``score`` lies between 0 and 1; a null or empty text and one without a word have 0 and no
    sentences. ``predicted`` is 1 from ``threshold`` on. Texts are read whole, repeated rows
    are scored each, and other columns are not read. An empty table gives no rows.
    """
    chosen = docs.select(key, text)
    frozen = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # BUCKETS numbers, whatever was learned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(frozen.value)
        weights = word_weights(own)
        for batch in slices(batches, text, 4 << 20):
            told, found = zip(*[judged(t, own.bias, weights, threshold) for t in column_of(batch, text)], strict=True)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(told, pa.float64()), pa.array([int(s >= threshold) for s in told], pa.int32()), pa.array(found, SENTENCES),
            ], names=[key, "score", "predicted", "sentences"])

    kind = chosen.schema[0].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{key}` {kind}, score double, predicted int, sentences array<struct<start:int,length:int,score:double>>")


def held_out(key: str = "doc_id", parts: int = 4) -> Column:
    return crc_share(key, parts) == F.lit(2)

"""An interpolated modified Kneser-Ney bigram model, counted in Spark and scored from mapped files.

Counting: every task counts the words and pairs of its texts and sends them, as sorted
arrays, to parts by ranges of their hashes. A part adds up its pairs and writes them to a file
in the shared folder: hashes in order, and counts beside them. What pairs say about their
first and last words (continuations, followers by count) goes to parts of words, which write
the same kind of file. A part is a range of hashes, so neither a frequent word nor a frequent
pair weighs on one task; the model grows with the texts and passes no driver.

Scoring: every worker maps the files and looks up the sorted distinct words and pairs of a
batch of texts by binary search.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gridscope.llm.common import column_of, slices, staged
from gridscope.llm.shared_files import map_file, write_file
from gridscope.session import scratch_path

#: Hashed like words, but with a space, which no word has.
BEGIN, END = b" begin", b" end"
#: Tokens that a task counts before it sends what it has.
FLUSH_TOKENS = 3_000_000
#: Bytes of text scored at once.
SCORE_BYTES = 6 << 20
#: What a part keeps of its words, each in a file of its own.
WORD = {"hash": "<u8", "n": "<u8", "before": "<u4", "once": "<u4", "twice": "<u4", "more": "<u4"}


@dataclass(frozen=True)
class KneserNey:
    """Where a model's files are, and its totals: all that travels to the workers."""

    folder: str
    parts: int
    tokens: int
    words: int
    pairs: int
    #: Words by number of different words before them: one, two, three or more.
    before: tuple[int, int, int]
    #: Discounts of pair counts and of continuation counts of one, two, three or more.
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (first >> np.uint64(31))
    mixed = (mixed + second) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(30)
    mixed *= np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(31))


def _borders(parts: int) -> np.ndarray:
    return np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)


def _split(hashes: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """``part, start, end`` of the ranges of sorted hashes that are not empty."""
    at = [0, *np.searchsorted(hashes, _borders(parts)).tolist(), len(hashes)]
    return [(p, a, b) for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]


class _Tokens:
    """Texts as local word numbers, with the numbers of the two marks first."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {BEGIN: 0, END: 1}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str | None) -> None:
        words, number = words_of(text), self.number
        for word in words:
            if word not in number:
                number[word] = len(number)
        ids = np.empty(len(words) + 2, np.int64)
        ids[0], ids[-1] = 0, 1
        ids[1:-1] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        self.parts.append(ids)
        self.size += len(ids)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of every local word, and the first and last word of every place in every text."""
        ids = np.concatenate(self.parts)
        inside = ids[:-1] != 1
        return hashes_of(list(self.number)), ids[:-1][inside], ids[1:][inside]


def _message(part: int, kind: int, *arrays: np.ndarray) -> dict:
    sent = {"part": part, "kind": kind, "n": len(arrays[0])}
    return sent | {f"a{k}": arrays[k].tobytes() if k < len(arrays) else None for k in range(5)} | {"levels": None}


_SENT = "part int, kind int, n long, a0 binary, a1 binary, a2 binary, a3 binary, a4 binary"
_LEVELS = ", levels array<long>"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _as_batch(messages: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        f.split()[0]: pa.array([m.get(f.split()[0]) for m in messages], _TYPES[f.split()[1]]) for f in _SENT.split(", ")
    })


def _count(parts: int):
    """Counts of words (kind 0) and pairs (kind 1), sent by range of their hashes."""

    def flush(tokens: _Tokens) -> Iterator[pa.RecordBatch]:
        hashes, first, last = tokens.pairs()
        count = np.bincount(last, minlength=len(hashes))
        count[0] = int((first == 0).sum())
        order = np.argsort(hashes)
        order = order[count[order] > 0]
        sent = [_message(p, 0, hashes[order[a:b]], count[order[a:b]].astype("<u4")) for p, a, b in _split(hashes[order], parts)]
        yield _as_batch(sent)
        both, n = np.unique(first * len(hashes) + last, return_counts=True)
        first, last = both // len(hashes), both % len(hashes)
        # Inside a part the pairs of a first word stay together, which names it once.
        part = np.searchsorted(_borders(parts), pair_hashes(hashes[first], hashes[last]), side="right")
        order = np.argsort(part, kind="stable")
        ends = np.cumsum(np.bincount(part, minlength=parts))
        for p, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            if b > a:
                own = order[a:b]
                heads, lengths = np.unique(first[own], return_counts=True)
                yield _as_batch([_message(
                    p, 1, hashes[heads], lengths.astype("<u4"), hashes[last[own]], (n[own] - 1).astype("<u4")
                )])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens()
        for batch in slices(batches, "text"):
            for text in column_of(batch, "text"):
                tokens.add(text)
                if tokens.size >= FLUSH_TOKENS:
                    yield from flush(tokens)
                    tokens = _Tokens()
        if tokens.size:
            yield from flush(tokens)

    return run


def _array(data: bytes | None, kind: str) -> np.ndarray:
    return np.frombuffer(data or b"", kind)


def _added(hashes: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct hashes and the sums of their values."""
    distinct, place = np.unique(hashes, return_inverse=True)
    return distinct, *(np.bincount(place, v, len(distinct)).astype(np.int64) for v in values)


def _levels(n: np.ndarray) -> list[int]:
    """How many numbers are one, two, three and four."""
    return np.bincount(np.minimum(n, 5), minlength=5)[1:5].tolist()


def _add_pairs(folder: str, parts: int):
    """Write the pairs of a part; tell their words' parts what follows from them (kind 2), and the levels (kind 3).

    Counts of words pass on to their part, added up.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        part, sent = int(group["part"].iloc[0]), []
        own = group[group["kind"] == 0]
        if len(own):
            hashes, n = _added(np.concatenate([_array(h, "<u8") for h in own["a0"]]), np.concatenate([_array(c, "<u4") for c in own["a1"]]))
            sent.append(_message(part, 0, hashes, n.astype("<u8")))
        group = group[group["kind"] == 1]
        if len(group):
            sent += pairs(part, group)
        return pd.DataFrame({k: pd.Series([m[k] for m in sent], dtype=object) for k in sent[0]})

    def pairs(part: int, group: pd.DataFrame) -> list[dict]:
        first = np.concatenate([np.repeat(_array(h, "<u8"), _array(k, "<u4")) for h, k in zip(group["a0"], group["a1"], strict=True)])
        last = np.concatenate([_array(w, "<u8") for w in group["a2"]])
        n = np.concatenate([_array(c, "<u4") for c in group["a3"]]).astype(np.int64) + 1
        hashes, at, place = np.unique(pair_hashes(first, last), return_index=True, return_inverse=True)
        n = np.bincount(place, n, len(hashes)).astype(np.int64)
        first, last = first[at], last[at]
        write_file(f"{folder}/pairs-{part}", hashes.astype("<u8").tobytes())
        write_file(f"{folder}/pair-counts-{part}", np.minimum(n, 2**32 - 1).astype("<u4").tobytes())
        ones, twos, more = (n == 1), (n == 2), (n > 2)
        words = np.concatenate([first, last])
        nothing = np.zeros(len(first), bool)
        told = _added(words, *(np.concatenate(v) for v in ((nothing, ~nothing), (ones, nothing), (twos, nothing), (more, nothing))))
        sent = [_message(p, 2, told[0][a:b], *(t[a:b].astype("<u4") for t in told[1:])) for p, a, b in _split(told[0], parts)]
        return [*sent, dict.fromkeys(sent[0]) | {"part": 0, "kind": 3, "n": len(n), "levels": [*_levels(n), len(n)]}]

    return run


def _add_words(folder: str):
    """Write the words of a part; return its totals and the levels it was told."""
    begin = hashes_of([BEGIN])[0]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        hashes, values, levels = [np.zeros(0, "<u8")], [np.zeros((5, 0), np.int64)], np.zeros(5, np.int64)
        for row in group.itertuples(index=False):
            if row.kind == 3:
                levels += np.array(row.levels, np.int64)
                continue
            hashes.append(_array(row.a0, "<u8"))
            column = np.zeros((5, len(hashes[-1])), np.int64)
            if row.kind == 0:
                column[0] = _array(row.a1, "<u8")
            else:
                column[1:] = [_array(a, "<u4") for a in (row.a1, row.a2, row.a3, row.a4)]
            values.append(column)
        distinct, *sums = _added(np.concatenate(hashes), *np.concatenate(values, axis=1))
        for (name, kind), column in zip(WORD.items(), (distinct, *sums), strict=True):
            write_file(f"{folder}/words-{name}-{part}", column.astype(kind).tobytes())
        real, (n, before) = distinct != begin, sums[:2]
        return pd.DataFrame({"totals": [[
            int(n[real].sum()), int((n[real] > 0).sum()), *_levels(before), int((before > 2).sum()), *levels.tolist()
        ]]})

    return run


def discounts(levels: list[int]) -> tuple[float, float, float]:
    """The three discounts from how many counts are one to four; half a count a level where one is missing."""
    found = []
    share = levels[0] / (levels[0] + 2 * levels[1]) if levels[0] else 0.0
    for k in range(3):
        value = (k + 1) - (k + 2) * share * levels[k + 1] / levels[k] if levels[k] and levels[k + 1] else 0.5 * (k + 1)
        found.append(min(max(value, 0.0), k + 1.0))
    return tuple(found)


def train(docs: DataFrame, learn: Column, text: str = "text", part_bytes: int = 24_000_000) -> KneserNey:
    """Count the texts where ``learn`` holds. A null text counts as empty and is an end alone.

    A part of the model holds the words and pairs of about ``part_bytes`` of text.
    """
    rows = docs.where(learn).select(F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    folder = scratch_path(docs.sparkSession, "kneser-ney")
    counted = rows.mapInArrow(_count(parts), _SENT)
    about = counted.groupBy("part").applyInPandas(_add_pairs(folder, parts), _SENT + _LEVELS)
    totals = staged(about.groupBy("part").applyInPandas(_add_words(folder), "totals array<long>"), "totals")
    summed = totals.agg(*[F.coalesce(F.sum(F.get("totals", F.lit(k))), F.lit(0)) for k in range(12)]).first()
    tokens, kinds, b1, b2, b3, b4, more, *levels, pairs = map(int, summed)
    return KneserNey(
        folder, parts, tokens, kinds, pairs, (b1, b2, more), discounts(levels), discounts([b1, b2, b3, b4])
    )


class Lookup:
    """The files of a model, mapped by this worker."""

    def __init__(self, model: KneserNey):
        self.model = model
        self.begin = hashes_of([BEGIN, END])

    @functools.lru_cache(maxsize=None)  # noqa: B019 - one object per worker; maps, not copies
    def file(self, name: str, part: int, kind: str) -> np.ndarray:
        try:
            return map_file(f"{self.model.folder}/{name}-{part}", np.dtype(kind))
        except FileNotFoundError:
            return np.zeros(0, kind)

    def find(self, sorted_hashes: np.ndarray, keys: str, values: dict[str, str]) -> dict[str, np.ndarray]:
        """Values of sorted hashes; zero where a hash is unknown."""
        found = {v: np.zeros(len(sorted_hashes), np.int64) for v in values}
        for part, a, b in _split(sorted_hashes, self.model.parts):
            known = self.file(keys, part, "<u8")
            if len(known):
                at = np.minimum(np.searchsorted(known, sorted_hashes[a:b]), len(known) - 1)
                hit = known[at] == sorted_hashes[a:b]
                for v, kind in values.items():
                    found[v][a:b][hit] = self.file(v, part, kind)[at[hit]]
        return found

    def score(self, texts: list[str | None]) -> list[tuple[int, int, float, float]]:
        """Tokens, known tokens, base score and model score of each text."""
        m, tokens = self.model, _Tokens()
        for text in texts:
            tokens.add(text)
        hashes, first, last = tokens.pairs()
        order = np.argsort(hashes)
        told = self.find(hashes[order], "words-hash", {f"words-{k}": v for k, v in WORD.items() if k != "hash"})
        word = {k: np.empty(len(hashes), np.int64) for k in told}
        for k, v in told.items():
            word[k][order] = v
        n, before = word["words-n"], word["words-before"]
        word_cut, pair_cut = np.array([0.0, *m.word_discounts]), np.array([0.0, *m.pair_discounts])
        spread = sum(d * b for d, b in zip(m.word_discounts, m.before, strict=True))
        alone = np.maximum(before - word_cut[np.minimum(before, 3)], 0.0) / max(m.pairs, 1)
        alone += (spread / m.pairs if m.pairs else 1.0) / (m.words + 1)
        left = m.pair_discounts[0] * word["words-once"] + m.pair_discounts[1] * word["words-twice"] + m.pair_discounts[2] * word["words-more"]
        seen = n > 0
        back = np.where(seen, left / np.maximum(n, 1), 1.0)
        both, place = np.unique(first * len(hashes) + last, return_inverse=True)
        v, w = both // len(hashes), both % len(hashes)
        pairs = pair_hashes(hashes[v], hashes[w])
        order = np.argsort(pairs)
        count = np.empty(len(pairs), np.int64)
        count[order] = self.find(pairs[order], "pairs", {"pair-counts": "<u4"})["pair-counts"]
        direct = np.maximum(count - pair_cut[np.minimum(count, 3)], 0.0) / np.maximum(n[v], 1)
        score = np.log10(np.where(seen[v], direct, 0.0) + back[v] * alone[w])[place]
        base = np.log10((n + 0.5) / (m.tokens + 0.5 * (m.words + 1)))[last]
        lengths = np.array([len(p) - 1 for p in tokens.parts])
        starts = np.cumsum(lengths) - lengths
        known = np.add.reduceat(seen[last].astype(np.int64), starts)
        return list(zip(
            lengths.tolist(), known.tolist(), np.add.reduceat(base, starts).tolist(), np.add.reduceat(score, starts).tolist(), strict=True
        ))


@functools.lru_cache(maxsize=2)
def lookup(model: KneserNey) -> Lookup:
    return Lookup(model)


def score(docs: DataFrame, model: KneserNey, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, n_known, base_score, score, perplexity`` for every row of ``docs``.

    Scores are log10 probabilities of the whole text and its end. A null text counts as empty.
    Repeated rows are scored each; other columns are not read.
    """
    chosen = docs.select(F.col(key), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lookup(model)
        for batch in slices(batches, "text", SCORE_BYTES):
            n, known, base, total = zip(*own.score(column_of(batch, "text")), strict=True)
            perplexity = [10.0 ** min(300.0, -s / k) for s, k in zip(total, n, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), *(pa.array(c, pa.float64()) for c in (base, total, perplexity))],
                names=[key, "n_tokens", "n_known", "base_score", "score", "perplexity"],
            )

    return chosen.mapInArrow(
        run, f"`{key}` {chosen.schema[0].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double, perplexity double"
    )

"""Ranked lexical search over an index of document segments.

The index holds segments of documents, each with its posting lists: places of documents and
how often they hold the term. A search builds, per segment, a range-maximum sparse table over
the impacts of every wanted posting list. Intervals of documents are then taken best first:
an interval's bound is the sum of its terms' range maxima; it is split at the document with
the largest single impact, that document is scored exactly, and both halves are bounded anew.
What cannot reach the best ten any more is never looked at.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridscope.llm.common import column_of, slices, staged

#: Every byte that parts terms becomes a space, A-Z become a-z, all others stay.
_TERM_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
#: Bytes of text of one segment, and intervals that are split at once.
SEGMENT_BYTES, WAVE = 6 << 20, 96
#: Bytes of the items that are searched for together; a longer item is searched for alone.
BLOCK_BYTES = 8 << 20
#: Low bits of a packed impact: the place, counted down so that the first of equal impacts is the maximum.
PLACE_BITS = 24
NO_KEY = np.iinfo(np.int64).max
INDEX = "docs int, counted long, tokens long, keys binary, lengths binary, terms array<string>, dfs binary, places binary, tfs binary"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TERM_BYTES).split()


def weight_of(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments of ``docs`` with their posting lists, written once: one row per segment.

    Every row of ``docs`` is a document, repeated ones too; ``key`` is an integer and may be
    null. Texts are read whole. ``counted`` documents have at least one term, ``tokens`` is
    the number of their terms with repeats.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SEGMENT_BYTES):
            keys = np.array([NO_KEY if k is None else k for k in column_of(batch, "key")], np.int64)
            order = np.argsort(keys, kind="stable")
            texts = column_of(batch, "text")
            numbers: defaultdict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            held = [np.fromiter(map(numbers.__getitem__, terms_of(texts[k])), np.int64) for k in order.tolist()]
            lengths = np.array([len(h) for h in held], np.int64)
            postings = np.concatenate(held) * len(held) + np.repeat(np.arange(len(held)), lengths)
            postings, tfs = np.unique(postings, return_counts=True)
            dfs = np.bincount(postings // len(held), minlength=len(numbers))
            yield pa.RecordBatch.from_pydict({
                "docs": pa.array([len(held)], pa.int32()), "counted": pa.array([int((lengths > 0).sum())]), "tokens": pa.array([int(lengths.sum())]),
                "keys": pa.array([keys[order].tobytes()], pa.binary()), "lengths": pa.array([lengths.tobytes()], pa.binary()),
                "terms": pa.array([[t.decode("utf-8") for t in numbers]], pa.list_(pa.string())),
                "dfs": pa.array([dfs.astype("<u4").tobytes()], pa.binary()),
                "places": pa.array([(postings % len(held)).astype("<u4").tobytes()], pa.binary()),
                "tfs": pa.array([tfs.astype("<u4").tobytes()], pa.binary()),
            })

    chosen = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return staged(chosen.mapInArrow(run, INDEX), "lexical-index")


class Segment:
    """Posting lists of wanted terms in one segment, with a sparse table of range maxima over each.

    Lists follow each other in one array; a table's level k holds the maxima of 2^k postings
    in a row, and a range never leaves its list. Impacts carry the place of their document.
    """

    def __init__(self, row: dict, wanted: dict[str, int], mean: tuple[int, int]):
        n, tokens = mean
        self.keys = np.frombuffer(row["keys"], np.int64)
        self.size = len(self.keys)
        dfs = np.frombuffer(row["dfs"], "<u4").astype(np.int64)
        ends = np.cumsum(dfs)
        places, tfs = np.frombuffer(row["places"], "<u4"), np.frombuffer(row["tfs"], "<u4")
        found = [k for k, t in enumerate(row["terms"]) if t in wanted]
        self.number = {row["terms"][k]: j for j, k in enumerate(found)}
        parts = [slice(int(ends[k] - dfs[k]), int(ends[k])) for k in found]
        place = np.concatenate([places[p] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        tf = np.concatenate([tfs[p] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        sizes = dfs[found] if found else np.zeros(0, np.int64)
        lengths = np.frombuffer(row["lengths"], np.int64).tolist()
        damping = np.array([100 - 90 + (90 * m * n) // tokens if tokens else 10 for m in lengths], np.int64)
        impact = np.repeat([wanted[row["terms"][k]] for k in found], sizes) * ((1_000_000_000 * tf) // (1000 * tf + 8 * damping[place]))
        #: Term and place of every posting as one rising number.
        self.at = np.repeat(np.arange(len(found)), sizes) * self.size + place
        self.levels = [impact.astype(np.int64) << PLACE_BITS | ((1 << PLACE_BITS) - 1 - place)]
        width = 1
        while 2 * width <= (int(sizes.max()) if len(sizes) else 0):
            last = self.levels[-1]
            self.levels.append(np.maximum(last, np.append(last[width:], np.full(min(width, len(last)), -1))))
            width *= 2
        # All levels in one array, for one look-up of ranges of different lengths.
        self.table = np.concatenate(self.levels) if len(self.at) else np.zeros(0, np.int64)

    def bounds(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bound of each interval ``[low, high)`` of places, and the place of its largest impact."""
        base = terms[:, None] * self.size
        ends = np.searchsorted(self.at, np.concatenate([base + low, base + high], axis=1))
        first, last = ends[:, : len(low)], ends[:, len(low) :]
        count = last - first
        some = count > 0
        level = np.where(some, np.frexp(np.maximum(count, 1))[1] - 1, 0)
        here = level * len(self.at)
        left = self.table[np.where(some, here + first, 0)]
        right = self.table[np.where(some, here + last - (1 << level), 0)]
        best = np.where(some, np.maximum(left, right), 0)
        top = best.max(axis=0)
        return (best >> PLACE_BITS).sum(axis=0), (1 << PLACE_BITS) - 1 - (top & ((1 << PLACE_BITS) - 1))

    def scores(self, terms: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Exact scores of documents."""
        wanted = terms[:, None] * self.size + place
        k = np.minimum(np.searchsorted(self.at, wanted), len(self.at) - 1)
        return np.where(self.at[k] == wanted, self.levels[0][k] >> PLACE_BITS, 0).sum(axis=0)

    def search(self, terms: list[str], best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """``best`` (rising by rank: ``(-score, key)``) with the documents of this segment that enter the best ``k``."""
        numbers = np.array([self.number[t] for t in terms if t in self.number], np.int64)
        if not len(numbers):
            return best
        low, high = np.zeros(1, np.int64), np.full(1, self.size, np.int64)
        bound, split = self.bounds(numbers, low, high)
        while True:
            if len(best) == k:
                least, key = -best[-1][0], best[-1][1]
                live = (bound > least) | ((bound == least) & (self.keys[low] < key))
            else:
                live = bound > 0
            low, high, bound, split = low[live], high[live], bound[live], split[live]
            if not len(low):
                return best
            # The most promising intervals go first, a wave of them at once.
            now = np.argpartition(-bound, WAVE)[:WAVE] if len(bound) > WAVE else np.arange(len(bound))
            at, score = split[now], self.scores(numbers, split[now])
            entering = score > (-best[-1][0] - 1 if len(best) == k else 0)
            if entering.any():
                best = sorted([*best, *zip((-score[entering]).tolist(), self.keys[at[entering]].tolist(), strict=True)])[:k]
            new_low, new_high = np.concatenate([low[now], at + 1]), np.concatenate([at, high[now]])
            full = new_low < new_high
            new_low, new_high = new_low[full], new_high[full]
            rest = np.ones(len(low), bool)
            rest[now] = False
            new_bound, new_split = self.bounds(numbers, new_low, new_high)
            low, high = np.concatenate([low[rest], new_low]), np.concatenate([high[rest], new_high])
            bound, split = np.concatenate([bound[rest], new_bound]), np.concatenate([split[rest], new_split])


def _blocks_of(items: DataFrame) -> tuple[DataFrame, int]:
    """``items`` with a ``block`` each, so that a block of several items holds ``BLOCK_BYTES`` at most."""
    size = F.octet_length("text") + 16
    total = items.agg(F.sum(size).alias("b")).first()["b"] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    while True:
        blocked = items.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(n)))
        if n == 1 and total <= BLOCK_BYTES:
            return blocked, n
        crowded = blocked.groupBy("block").agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("b") > BLOCK_BYTES))
        if crowded.isEmpty():
            return blocked, n
        n *= 2


def search(segments: DataFrame, items: DataFrame, item_key: str = "item_id", text: str = "text", key: str = "doc_id", k: int = 10) -> DataFrame:
    """``item_key, rank, key, score``: the ``k`` best documents of the index for each row of ``items``.

    Scores above 0 only, equal ones by rising key, keys that are null last. An item's terms
    count once each; an item without terms, also a null text, has no rows. Repeated item keys
    are items each. Items are searched for in blocks of bounded size, against all segments.
    """
    spark = segments.sparkSession
    sums = segments.agg(F.sum("counted").alias("n"), F.sum("tokens").alias("tokens")).first()
    n, tokens = sums["n"] or 0, sums["tokens"] or 0
    rows = staged(items.select(
        F.monotonically_increasing_id().alias("no"), F.col(item_key).alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ), "items")
    blocked, n_blocks = _blocks_of(rows)
    found = None
    for block in range(n_blocks):
        asked = {r["no"]: sorted({t.decode("utf-8") for t in terms_of(r["text"])}) for r in blocked.where(F.col("block") == block).collect()}
        part = _search_block(segments, {no: terms for no, terms in asked.items() if terms}, n, tokens, k)
        part = part if n_blocks == 1 else staged(part, "found")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.join(rows.select("no", "item"), "no").select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score")


def _search_block(segments: DataFrame, asked: dict[int, list[str]], n: int, tokens: int, k: int) -> DataFrame:
    """``no, key, score``: each task's ``k`` best for the items of one block."""
    context = segments.sparkSession.sparkContext
    vocabulary = context.broadcast(pickle.dumps({t for terms in asked.values() for t in terms}))  # of one block, BLOCK_BYTES or one item

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = pickle.loads(vocabulary.value), defaultdict(int)
        for batch in batches:
            for terms, dfs in zip(column_of(batch, "terms"), column_of(batch, "dfs"), strict=True):
                for term, df in zip(terms, np.frombuffer(dfs, "<u4").tolist(), strict=True):
                    if term in wanted:
                        total[term] += df
        yield pa.RecordBatch.from_pydict({"term": pa.array(total, pa.string()), "df": pa.array(total.values(), pa.int64())})

    counted = segments.select("terms", "dfs").mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = {r["term"]: weight_of(r["df"], n) for r in counted.collect()}  # terms of one block
    weights = {t: w for t, w in weights.items() if w > 0}
    given = {no: held for no, terms in asked.items() if (held := [t for t in terms if t in weights])}
    frozen = context.broadcast(pickle.dumps((weights, given)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, items = pickle.loads(frozen.value)
        best: dict[int, list[tuple[int, int]]] = {no: [] for no in items}
        for batch in batches:
            for place in range(batch.num_rows):
                segment = Segment({name: batch.column(name)[place].as_py() for name in ("keys", "lengths", "terms", "dfs", "places", "tfs")}, wanted, (n, tokens))
                for no, terms in items.items():
                    best[no] = segment.search(terms, best[no], k)
        rows = [(no, None if key == NO_KEY else key, -score) for no, told in best.items() for score, key in told]
        no, keys, scores = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_pydict({"no": pa.array(no, pa.int64()), "key": pa.array(keys, pa.int64()), "score": pa.array(scores, pa.int64())})

    return segments.mapInArrow(run, "no long, key long, score long")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term
  FROM documents
),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term
  FROM benchmark
),
n AS (SELECT count(DISTINCT row)::BIGINT AS docs, count(*)::BIGINT AS tokens FROM d),
m AS (SELECT row, 100 - 90 + ((90 * count(*) * any_value(docs)) // any_value(tokens)) AS m FROM d CROSS JOIN n GROUP BY row),
p AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*)::BIGINT AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY row, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p CROSS JOIN n GROUP BY term),
scored AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY item_id, row
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

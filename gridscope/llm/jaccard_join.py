"""Near duplicates by a similarity join on word n-grams.

A document is the set of its word shingles. All documents order shingles alike, rarest first,
so that two sets with a high Jaccard similarity must share a shingle among the first few of
each. Documents that share one, and pass the length and positional filters there, are
candidates; a suffix filter and an exact comparison decide each pair once.

* Rarity is the exact number of documents with a shingle (of its first 48 bits). Texts are
  handled in chunks of neighbouring rows. Each chunk sends its sorted distinct shingles in
  pieces by range, and gets back one byte of rarity per shingle, in the same order.
* Equal sets are one class; only the first document of a class takes part in the join.
* Links are looked for in two steps, so that a large group of near copies does not become all
  its pairs: first only neighbours and firsts under each shared shingle are compared, then
  every pair under a shared shingle that the first step left in different components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, Window

from gridscope.llm.common import column_of, forget, rows_with, slices, staged, text_or_empty
from gridscope.llm.components import components

#: Bits of a shingle's hash that its rarity is counted by.
RARITY_BITS = 48
#: Words a worker remembers.
CACHE_WORDS = 500_000


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes."""

    def __init__(self, size: int):
        self.size = size
        self.known: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        """The set of a text: empty without words, its whole sequence when it has too few."""
        words = (text or "").encode("utf-8").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.size:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(ids) - self.size + 1
        mixed = np.zeros(n, np.uint64)
        for k in range(self.size):
            mixed = (mixed ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(mixed ^ (mixed >> np.uint64(32)))


def _rarity_key(sets: np.ndarray) -> np.ndarray:
    return sets >> np.uint64(64 - RARITY_BITS)


def _cut(keys: np.ndarray, parts: int) -> np.ndarray:
    """Borders of the ranges of sorted rarity keys."""
    edges = np.array([(k << RARITY_BITS) // parts for k in range(parts + 1)], np.uint64)
    return np.searchsorted(keys, edges)


def _send(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as gaps of four bytes each; as they are where a gap is wider."""
    gaps = np.diff(keys, prepend=keys[:1])
    if len(keys) and gaps.max() < 1 << 32:
        return b"g" + keys[:1].tobytes() + gaps.astype("<u4").tobytes()
    return b"k" + keys.tobytes()


def _receive(data: bytes) -> np.ndarray:
    if data[:1] == b"k":
        return np.frombuffer(data, np.uint64, offset=1)
    return np.frombuffer(data, np.uint64, 1, 1) + np.cumsum(np.frombuffer(data, "<u4", offset=9), dtype=np.uint64)


def overlap_needed(total: Column, percent: int) -> Column:
    """Least intersection of two sets with so many members together."""
    return F.ceil(F.lit(percent) * total / F.lit(100 + percent))


def shingled(
    docs: DataFrame, key: str, text: str, size: int, percent: int, chunk_rows: int, part_keys: int, with_sha: bool = False,
) -> DataFrame:
    """One row per document: its set, and the shared shingles of its prefix with their places.

    ``row, key, n, d1, d2`` (two halves of a digest of the set), ``prefix`` (``token, pos,
    rarity``) of the shingles that another document has too, and ``members``, the set's
    sorted hashes where there are any; with ``with_sha`` also ``sha``, the SHA-256 of the text,
    where a null counts as empty. ``docs`` is read twice and must give its rows in the
    same order each time, as a table of files does; a difference is an error.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.withColumn("chunk", F.floor(F.col("row") / F.lit(chunk_rows)).cast("long"))
    volume = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    # A word has six bytes or so; only the balance of the ranges hangs on it.
    parts = max(1, int(volume // (6 * part_keys)))

    def tell(chunk: int, sets: list[np.ndarray]) -> pa.RecordBatch:
        members = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        keys, count = np.unique(_rarity_key(members), return_counts=True)
        borders = _cut(keys, parts)
        told = [(p, keys[a:b], count[a:b]) for p, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_pydict({
            "part": pa.array([p for p, _, _ in told], pa.int32()), "chunk": pa.array([chunk] * len(told), pa.int64()),
            "keys": pa.array([_send(k) for _, k, _ in told], pa.binary()),
            "more": pa.array([np.minimum(c - 1, 2**32 - 1).astype("<u4").tobytes() if c.max() > 1 else b"" for _, _, c in told], pa.binary()),
        })

    def count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingler, chunk, sets = Shingler(size), None, []
        for batch in slices(batches, "text"):
            for at, text in zip(column_of(batch, "chunk"), column_of(batch, "text"), strict=True):
                if at != chunk and sets:
                    yield tell(chunk, sets)
                    sets = []
                chunk = at
                sets.append(shingler.of(text))
        if sets:
            yield tell(chunk, sets)

    def rate(group: pd.DataFrame) -> pd.DataFrame:
        keys = [_receive(k) for k in group["keys"]]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = [np.frombuffer(m, "<u4").astype(np.int64) + 1 if len(m) else np.ones(len(k), np.int64) for m, k in zip(group["more"], keys, strict=True)]
        held = np.bincount(place, np.concatenate(counts), len(every))
        rarity = np.minimum(255, np.rint(8 * np.log2(held))).astype(np.uint8)[place]
        borders = np.cumsum([0, *map(len, keys)])
        return pd.DataFrame({
            "chunk": group["chunk"], "part": group["part"],
            "rarity": [rarity[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:], strict=True)],
        })

    told = rows.select("chunk", "text").mapInArrow(count_keys, "part int, chunk long, keys binary, more binary")
    rarities = told.groupBy("part").applyInPandas(rate, "chunk long, part int, rarity binary")

    def describe(group: pa.Table, rated: pa.Table) -> pa.Table:
        shingler, sets, shas = Shingler(size), [], []
        for batch in group.to_batches():
            for content in column_of(batch, "text"):
                sets.append(shingler.of(content))
                if with_sha:
                    shas.append(hashlib.sha256((content or "").encode("utf-8")).hexdigest())
        keys = np.unique(_rarity_key(np.concatenate(sets))) if sets else np.zeros(0, np.uint64)
        rarity = np.frombuffer(b"".join(column_of(rated.sort_by("part"), "rarity")), np.uint8)
        if len(rarity) != len(keys):
            raise ValueError("the documents were read in another order the second time; hand in a written table")
        prefixes, digests = [], []
        for members in sets:
            rare = rarity[np.searchsorted(keys, _rarity_key(members))]
            n = len(members)
            length = n - -(-percent * n // 100) + 1 if n else 0
            order = np.lexsort((members, rare))[:length]
            pos = np.flatnonzero(rare[order])
            prefixes.append((members[order[pos]].astype(np.int64), pos.astype(np.int32), rare[order[pos]].astype(np.int32)))
            digests.append(np.frombuffer(hashlib.blake2b(members.tobytes(), digest_size=16).digest(), np.int64))
        token, pos, rare = (np.concatenate([p[k] for p in prefixes]) if prefixes else [] for k in range(3))
        listed = [len(p[0]) for p in prefixes]
        entry = pa.StructArray.from_arrays([pa.array(token, pa.int64()), pa.array(pos, pa.int32()), pa.array(rare, pa.int32())], ["token", "pos", "rarity"])
        return pa.table({
            "row": group.column("row"), "key": group.column("key"), "n": pa.array([len(m) for m in sets], pa.int64()),
            **{f"d{k + 1}": pa.array([d[k] for d in digests], pa.int64()) for k in range(2)},
            "prefix": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *listed]), pa.int32()), entry),
            "members": pa.array([m.tobytes() if k else None for m, k in zip(sets, listed, strict=True)], pa.binary()),
            **({"sha": pa.array(shas, pa.string())} if with_sha else {}),
        })

    kind = rows.schema["key"].dataType.simpleString()
    return staged(
        rows.groupBy("chunk").cogroup(rarities.groupBy("chunk")).applyInArrow(
            describe, f"row long, key {kind}, n long, d1 long, d2 long, prefix array<struct<token:bigint,pos:int,rarity:int>>, members binary"
            + (", sha string" if with_sha else "")
        ),
        "shingled",
    )


def in_index(n: Column, pos: Column, percent: int) -> Column:
    """Whether a place belongs to the shorter, indexed prefix, which a set meets larger ones with."""
    return pos < n - overlap_needed(F.lit(2) * n, percent) + 1


def candidate(x: str, y: str, percent: int) -> Column:
    """Length and positional filter of a pair under a shared shingle; ``x`` is the one with fewer members."""
    nx, ny, px, py = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    return (
        (F.lit(100) * nx >= F.lit(percent) * ny) & in_index(nx, px, percent)
        & (F.least(nx - px, ny - py) >= overlap_needed(nx + ny, percent))
    )


def _ordered_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct ``a, b`` of pairs ``p, q`` (structs of ``n, row, pos``) that pass the filters."""
    x, y = F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")
    return (
        pairs.where(F.col("p.row") != F.col("q.row")).select(x, y).where(candidate("x", "y", percent))
        .select(F.col("x.row").alias("a"), F.col("y.row").alias("b")).distinct()
    )


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough, after a suffix filter."""
    pivots = np.array([k << 61 for k in range(1, 8)], np.uint64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "left"):
            keep = []
            for k, (left, right) in enumerate(zip(column_of(batch, "left"), column_of(batch, "right"), strict=True)):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                needed = -(-percent * (len(x) + len(y)) // (100 + percent))
                # Members between two pivots can only meet members between the same ones.
                parts_x = np.diff(np.searchsorted(x, pivots), prepend=0, append=len(x))
                parts_y = np.diff(np.searchsorted(y, pivots), prepend=0, append=len(y))
                if np.minimum(parts_x, parts_y).sum() >= needed and len(np.intersect1d(x, y, assume_unique=True)) >= needed:
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).take(pa.array(keep, pa.int64()))

    left = sets.select(F.col("row").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("row").alias("b"), F.col("members").alias("right"))
    return staged(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(compare, "a long, b long"), "links")


def _rooted(rows: DataFrame, percent: int, block: int, best: Column) -> tuple[DataFrame, DataFrame]:
    """``d1, d2, n, root`` of every class of equal sets of ``rows``, and per ``root`` the least ``best`` as ``component_id``."""
    classes = rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("row").alias("first"), F.min(best).alias("least_key"))
    classes = staged(classes, "classes")
    firsts = classes.select(F.col("first").alias("row"))
    sets = staged(rows.where("members is not null").join(firsts, "row", "left_semi").select("row", "n", "prefix", "members"), "sets")
    entries = sets.select("row", "n", F.explode("prefix").alias("e")).select(
        F.col("e.token").alias("token"), F.struct("n", "row", F.col("e.pos").alias("pos")).alias("p"),
        F.ceil(F.pow(F.lit(2.0), F.col("e.rarity") / 8) / F.lit(block)).cast("int").alias("blocks"),
    )
    # A token that many documents hold is dealt into blocks, by the number of its documents. In
    # a block, the shingle's place in its document comes first: the one with the fewest rarer
    # shingles is the likeliest centre of a group of near copies.
    dealt = entries.withColumn("block", F.pmod(F.xxhash64("p.row"), F.col("blocks")))
    under = Window.partitionBy("token", "block").orderBy("p.pos", "p.n", "p.row")
    beside = dealt.withColumn("before", F.lag("p").over(under)).withColumn("top", F.first("p").over(under))
    near = beside.where("before is not null").select("p", F.explode(F.array("before", "top")).alias("q"))
    members = sets.select("row", "members")
    links = verified(_ordered_pairs(near, percent), members, percent)
    roots = staged(components(links), "roots")
    # What shares a token but no component yet is compared pair by pair. The filters are part
    # of the join, so that only candidates leave it.
    held = (
        dealt.join(roots.withColumnRenamed("row", "r"), F.col("p.row") == F.col("r"), "left")
        .select("token", "p", F.coalesce("root", "p.row").alias("root"))
    )
    mixed = held.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    held = staged(held.join(mixed, "token", "left_semi"), "mixed")
    smaller = held.select("token", F.col("p").alias("x"), F.col("root").alias("x_root"))
    smaller = smaller.where(in_index(F.col("x.n"), F.col("x.pos"), percent))
    larger = held.select("token", F.col("p").alias("y"), F.col("root").alias("y_root"))
    apart = smaller.join(larger, (smaller["token"] == larger["token"]) & F.expr("x_root <> y_root and x < y") & candidate("x", "y", percent))
    pairs = apart.select(F.col("x.row").alias("a"), F.col("y.row").alias("b")).distinct()
    more = verified(pairs, members, percent)
    roots = staged(components(roots.select(F.col("row").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")
    rooted = staged(
        classes.join(roots.withColumnRenamed("row", "first"), "first", "left")
        .select("d1", "d2", "n", "least_key", F.coalesce("root", "first").alias("root")),
        "rooted",
    )
    least = staged(rooted.groupBy("root").agg(F.min("least_key").alias("component_id")), "component-ids")
    return rooted, least


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90, chunk_rows: int = 4096,
    part_keys: int = 2_000_000, block: int = 2048,
) -> DataFrame:
    """``key, n_shingles, component_id, row`` for every row of ``docs``.

    Two rows are linked when ``100 * intersection >= percent * union`` of their sets of
    ``size``-word shingles (words are parted by ASCII white space, A-Z count as lower case;
    shorter texts are one shingle). ``component_id`` is the least key among the rows that
    links lead to. Rows without words and null texts have empty sets and stay alone, also if
    their keys are null or repeat. Other columns are not read. An empty table gives no rows.
    """
    rows = shingled(docs, key, text, size, percent, chunk_rows, part_keys)
    rooted, least = _rooted(rows, percent, block, F.col("key"))
    named = staged(rooted.join(least, "root").select("d1", "d2", "n", "component_id"), "named")
    facts = rows.select("row", "key", "n", "d1", "d2")
    return facts.where("n > 0").join(named, ["d1", "d2", "n"]).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", "row"
    ).unionByName(facts.where("n = 0").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("key").alias("component_id"), "row"))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one with the least key (nulls last), then the first.

    Rows that repeat a key are told apart by their text, and so are rows without a key. Of
    rows without words, one of each key and text stays.
    """
    rows = shingled(docs, key, text, size, percent, 4096, 2_000_000, with_sha=True)
    _, least = _rooted(rows, percent, 2048, F.struct(F.col("key").isNull().alias("void"), "key", "row", "sha"))
    told = least.select("component_id.key", "component_id.sha").unionByName(rows.where("n = 0").select("key", "sha"))
    return rows_with(docs, told, {"key": F.col(key), "sha": F.sha2(text_or_empty(text), 256)}, key)

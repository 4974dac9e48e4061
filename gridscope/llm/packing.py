"""Packing of tokenised documents into sequences by a grouping genetic algorithm.

Documents become pieces of at most one sequence. Pieces that fill a sequence are done; the
others are dealt into regions of bounded size by a hash of their place. Every region is
solved by several islands. An island holds packings, and crosses them by bins: a child takes
over whole well-filled bins of one parent, loses the bins of the other parent that hold the
same pieces, and best-fits the displaced pieces again. After a round the islands of a region
pass their best packings on to the next one. The poorly filled sequences of all regions are
packed once more together.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridscope.llm.common import column_of, forget, kept, local_file, slices, staged

#: The white space of Unicode, and letters of Latin scripts, as character classes.
UNICODE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN = r"A-Za-zÀ-ÖØ-öø-ſ"
#: Byte-level BPE never merges across these borders, so ids can be looked up chunk by chunk: after
#: a run of letters that neither a letter nor another sign beyond ASCII follows, and around white space.
CHUNK = re.compile(
    f" ?[{LATIN}]++(?![\x80-\U0010ffff])| ?[^{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+(?![^{UNICODE_SPACE}])|[{UNICODE_SPACE}]+"
)
#: Chunks a worker remembers and their characters, and the bytes of text handled at once.
CACHE_CHUNKS, CACHE_CHARS, SLICE_BYTES = 800_000, 24_000_000, 6 << 20

Bins = list[tuple[int, list[int]]]


class Numbered(dict):
    """Numbers of chunks in the order they were first asked for; ``new`` lists those asked for lately."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number


class ChunkIds:
    """Ids of texts by the file of a byte-level BPE, remembered for a bounded number of chunks.

    The ids are those of the plain call of ``tokenizers``: the text of an added token, such as
    ``<|endoftext|>``, has that token's id.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: np.array([i], "<u4").tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = added
        self.cut_at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.number, self.table, self.chars = Numbered(), [], 0

    def _learn(self) -> None:
        """Ids of the new chunks, many at once: a line end is a token of its own between chunks that hold no white space but in front."""
        new, self.number.new = self.number.new, []
        for k in range(0, len(new), 2_000):
            part = new[k : k + 2_000]
            joined = [c for c in part if not c.isspace()] if len(self.line_end) == 1 else []
            coded = self.tokenizer.encode_batch_fast(["\n".join(joined)], add_special_tokens=False)[0].ids if joined else []
            ids = np.array(coded, "<u4")
            ends = np.append(np.flatnonzero(ids == self.line_end[0]), len(ids)).tolist() if joined else []
            found = {}
            if len(ends) == len(joined):
                raw, start = ids.tobytes(), 0
                for chunk, end in zip(joined, ends, strict=True):
                    found[chunk], start = raw[4 * start : 4 * end], end + 1
            self.table += [found[c] if c in found else np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in part]
            self.chars += sum(map(len, part))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.table) > CACHE_CHUNKS or self.chars > CACHE_CHARS:
            self._forget()
        number = self.number.__getitem__
        parts = [self.cut_at_added.split(t) if self.cut_at_added is not None else [t] for t in texts]
        told = [[p if k % 2 else list(map(number, CHUNK.findall(p))) for k, p in enumerate(cut)] for cut in parts]
        self._learn()
        ids = self.table.__getitem__
        return [b"".join([self.added[p] if k % 2 else b"".join(map(ids, p)) for k, p in enumerate(cut)]) for cut in told]


def pieces_of(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, keep_ids: bool = True,
) -> DataFrame:
    """Tokenised pieces: ``row, key, piece, start, length, ids_crc32`` and, if wanted, ``ids``.

    A document is its text's ids and ``end_id``; a null text counts as empty. Longer ones are
    cut into pieces of ``capacity`` ids, of which the first may be shorter. ``ids`` are
    little-endian unsigned 32-bit numbers. Other columns are not read.
    """
    chosen = docs.select(F.monotonically_increasing_id().alias("row"), key, text)
    kind = chosen.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(ChunkIds, local_file(tokenizer))
        for batch in slices(batches, text, SLICE_BYTES):
            owner, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, data in enumerate(own.encode([t or "" for t in column_of(batch, text)])):
                data += end
                total = len(data) // 4
                first = total % capacity or capacity
                begins = [0, *range(first, total, capacity)]
                for number, (a, b) in enumerate(zip(begins, [*begins[1:], total], strict=True)):
                    part = data[4 * a : 4 * b]
                    owner.append(k)
                    piece.append(number)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(part)
            at = pa.array(owner, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            names = ["row", key, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = f"row long, `{key}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return chosen.mapInArrow(run, fields)


def best_fit(bins: Bins, order: list[int], sizes: list[int], capacity: int) -> Bins:
    """``bins`` with the items of ``order`` added one by one, each to the fullest bin that has room.

    Bins are kept by their free room, and a bit set tells which amounts of room exist.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = 0
    bins = [(load, items) for load, items in bins]
    for k, (load, _) in enumerate(bins):
        rooms[capacity - load].append(k)
        present |= 1 << (capacity - load)
    for item in order:
        size = sizes[item]
        fitting = present >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            k = rooms[room].pop()
            if not rooms[room]:
                present ^= 1 << room
            load, items = bins[k]
            bins[k] = (load + size, [*items, item])
        else:
            k, room = len(bins), capacity
            bins.append((size, [item]))
        rooms[room - size].append(k)
        present |= 1 << (room - size)
    return bins


def fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins are better; among as many, unevenly filled ones are."""
    return len(bins), -sum((load / capacity) ** 2 for load, _ in bins)


def crossover(taker: Bins, giver: Bins, sizes: list[int], capacity: int, draw: random.Random) -> Bins:
    """``taker`` with some whole well-filled bins of ``giver`` injected."""
    full = sorted(giver, key=lambda b: -b[0])[: max(1, len(giver) // 2)]
    injected = draw.sample(full, max(1, len(full) // 3))
    moved = {i for _, items in injected for i in items}
    kept, displaced = [], []
    for load, items in taker:
        if moved.isdisjoint(items):
            kept.append((load, items))
        else:
            displaced += [i for i in items if i not in moved]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(kept + injected, displaced, sizes, capacity)


def mutate(bins: Bins, sizes: list[int], capacity: int, draw: random.Random) -> Bins:
    """``bins`` with the emptiest and a few random ones taken apart and fitted again."""
    ranked = sorted(bins, key=lambda b: b[0])
    out = ranked[:2] + draw.sample(ranked[2:], min(len(ranked) - 2, 3)) if len(ranked) > 2 else ranked
    gone = {id(b) for b in out}
    loose = [i for _, items in out for i in items]
    draw.shuffle(loose)
    return best_fit([b for b in bins if id(b) not in gone], loose, sizes, capacity)


def evolve(population: list[Bins], sizes: list[int], capacity: int, children: int, draw: random.Random, width: int) -> list[Bins]:
    """The best packings after ``children`` children; stops when no packing can have fewer bins."""
    least = -(-sum(sizes) // capacity)
    scored = sorted(((fitness(b, capacity), k, b) for k, b in enumerate(population)), key=lambda s: s[:2])
    for born in range(children):
        if scored[0][0][0] <= least:
            break
        if len(scored) > 1:
            taker, giver = draw.sample(range(min(len(scored), width)), 2)
            child = mutate(crossover(scored[taker][2], scored[giver][2], sizes, capacity, draw), sizes, capacity, draw)
        else:
            child = mutate(scored[0][2], sizes, capacity, draw)
        scored = sorted([*scored, (fitness(child, capacity), len(population) + born, child)], key=lambda s: s[:2])[:width]
    return [s[2] for s in scored]


def founders(sizes: list[int], capacity: int, width: int, draw: random.Random, enough: int) -> list[Bins]:
    """Best fit in falling order, and in orders that are more and more disturbed."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    found = [best_fit([], order, sizes, capacity)]
    while len(found) < width and len(found[0]) > enough:
        wide = capacity * 0.02 * len(found)
        keys = [sizes[i] + draw.uniform(-wide, wide) for i in range(len(sizes))]
        found.append(best_fit([], sorted(order, key=lambda i: -keys[i]), sizes, capacity))
    return found


def _packed(bins: Bins, n: int) -> bytes:
    of = np.zeros(n, "<i4")
    for k, (_, items) in enumerate(bins):
        of[items] = k
    return of.tobytes()


def _unpacked(data: bytes, sizes: list[int]) -> Bins:
    groups: dict[int, list[int]] = {}
    for i, k in enumerate(np.frombuffer(data, "<i4").tolist()):
        groups.setdefault(k, []).append(i)
    return [(sum(sizes[i] for i in items), items) for items in groups.values()]


def solve(
    items: DataFrame, capacity: int, islands: int, rounds: int, children: int, width: int = 5, elites: int = 2,
) -> DataFrame:
    """``region, row, piece, bin, offset`` for ``items`` (``region, row, piece, length``), one packing per region.

    Islands of a region see the same items; between rounds, the best ``elites`` packings of
    an island also go to the next island of its region.
    """
    spread = items.withColumn("island", F.explode(F.array([F.lit(k) for k in range(islands)])))
    stored = "region long, island int, bins int, evenness double, packing binary"

    def ordered(group: pd.DataFrame) -> tuple[pd.DataFrame, list[int]]:
        group = group.sort_values(["row", "piece"])
        return group, [int(x) for x in group["length"]]

    def step(key, group: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        forget()
        group, sizes = ordered(group)
        draw = random.Random(f"{key[0]}/{key[1]}/{len(came)}")
        least = -(-sum(sizes) // capacity)
        if len(came):
            population = [_unpacked(p, sizes) for p in sorted(set(came["packing"]))]
        else:
            population = founders(sizes, capacity, width, draw, least)
        best = evolve(population, sizes, capacity, children, draw, width)[:elites]
        scores = [fitness(b, capacity) for b in best]
        return pd.DataFrame({
            "region": key[0], "island": key[1], "bins": [s[0] for s in scores], "evenness": [s[1] for s in scores],
            "packing": [_packed(b, len(sizes)) for b in best],
        })

    by_island = spread.groupBy("region", "island")
    came = items.sparkSession.createDataFrame([], stored)
    for number in range(rounds):
        told = by_island.cogroup(came.groupBy("region", "island")).applyInPandas(step, stored)
        found = staged(told, f"islands-{number}")
        onward = found.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)))
        came = found.unionByName(onward)
    best = found.groupBy("region").agg(F.min(F.struct("bins", "evenness", "packing"))["packing"].alias("packing"))

    def place(key, group: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        group, sizes = ordered(group)
        number, offset, load = np.zeros(len(sizes), int), np.zeros(len(sizes), int), np.zeros(len(sizes), int)
        for k, (total, held) in enumerate(_unpacked(chosen["packing"].iloc[0], sizes)):
            at = 0
            for i in held:
                number[i], offset[i], load[i] = k, at, total
                at += sizes[i]
        return pd.DataFrame({"region": key[0], "row": group["row"], "piece": group["piece"], "bin": number, "offset": offset, "load": load})

    return items.groupBy("region").cogroup(best.groupBy("region")).applyInPandas(
        place, "region long, row long, piece int, bin long, offset long, load long"
    )


def pack(
    pieces: DataFrame, capacity: int = 2048, region_items: int = 4000, islands: int = 3, rounds: int = 2, children: int = 12,
    again_below: float = 0.98,
) -> DataFrame:
    """``pieces`` (``row, piece, length`` and any other columns) with ``sequence_id`` and ``offset``.

    ``pieces`` is read several times: hand in a written table. A region holds about
    ``region_items`` pieces, which bounds what a task holds; sequences filled below
    ``again_below`` are taken apart and packed once more across regions. An empty table gives
    no rows.
    """
    sizes = pieces.select("row", "piece", "length")
    small = sizes.where(F.col("length") < capacity)
    n = small.count()

    def dealt(items: DataFrame, rows: int, label: str) -> DataFrame:
        return items.withColumn("region", F.pmod(F.xxhash64("row", "piece", F.lit(label)), F.lit(max(1, -(-rows // region_items)))))

    first = staged(solve(dealt(small, n, "first"), capacity, islands, rounds, children), "packed")
    poor = F.col("load") < again_below * capacity
    loose = first.where(poor).select("row", "piece").join(small, ["row", "piece"])
    left = first.where(poor).count()
    second = solve(dealt(loose, left, "second"), capacity, islands, rounds, children)
    regions = max(1, -(-n // region_items))
    placed = first.where(~poor).unionByName(second.withColumn("region", F.col("region") + F.lit(regions)))
    packed = pieces.join(placed, ["row", "piece"]).withColumn("sequence_id", F.col("region") * F.lit(1 << 24) + F.col("bin"))
    full = (
        pieces.where(F.col("length") == capacity)
        .withColumn("offset", F.lit(0).cast("long")).withColumn("sequence_id", -F.monotonically_increasing_id() - F.lit(1))
    )
    columns = [*pieces.columns, "sequence_id", "offset"]
    return packed.select(columns).unionByName(full.select(columns))

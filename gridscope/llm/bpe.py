"""Byte-level BPE by recursive DuckDB queries inside every partition.

A worker keeps a DuckDB database of its own, in memory, with the tokens of a rank file and
the merge table that follows from them. The distinct words of a batch go in as token-position
rows; a recursive query joins neighbours with the merge table and contracts each word's
leftmost pair of least rank until no pair is left, whatever its length. Ordered aggregation turns positions back
into ids and ids into bytes. Spark only deals out the texts.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridscope.llm.common import column_of, local_file, slices

#: Bytes of the words that one recursive query contracts; a longer word goes alone.
CALL_BYTES = 300_000
#: Words of more bytes than this are contracted at many places a step.
LONG_WORD = 256
#: Distinct words a worker remembers, and their characters.
CACHE_WORDS, CACHE_CHARS = 600_000, 20_000_000
#: Bytes of text handled at once.
SLICE_BYTES = 6 << 20

#: Every row knows its next token, so that a step needs no order. Per word, the leftmost pair of
#: least rank is contracted; only the latest state of a position is kept, and one that is
#: contracted away has the token -1.
SHORT_WORDS = """
WITH RECURSIVE state(word, pos, tok, next_pos, next_tok) USING KEY (word, pos) AS (
  SELECT word, pos, tok, pos + 1, lead(tok) OVER (PARTITION BY word ORDER BY pos) FROM start
  UNION ALL
  (
    WITH best AS (
      SELECT s.word, min(m.merged::BIGINT << 32 | s.pos) AS pair, arg_min(s.next_pos, m.merged::BIGINT << 32 | s.pos) AS q
      FROM state s JOIN merges m ON m.lhs = s.tok AND m.rhs = s.next_tok GROUP BY s.word
    ),
    gone AS (
      SELECT b.word, (b.pair & 4294967295)::INT AS p, (b.pair >> 32)::INT AS merged, b.q, s.next_pos, s.next_tok
      FROM best b JOIN state s ON s.word = b.word AND s.pos = b.q
    )
    SELECT s.word, s.pos, CASE WHEN s.pos = g.p THEN g.merged WHEN s.pos = g.q THEN -1 ELSE s.tok END,
           CASE WHEN s.pos = g.p THEN g.next_pos ELSE s.next_pos END,
           CASE WHEN s.pos = g.p THEN g.next_tok WHEN s.next_pos = g.p THEN g.merged ELSE s.next_tok END
    FROM state s JOIN gone g ON g.word = s.word WHERE s.tok >= 0
  )
)
"""
#: The same contraction for long words. Where no token made from the pair's result has a lower
#: rank (``safe``), the leftmost, the next leftmost and so on are contracted in one step: nothing
#: could come between them.
LONG_WORDS = """
WITH RECURSIVE state(word, pos, tok) USING KEY (word, pos) AS (
  SELECT word, pos, tok FROM start
  UNION ALL
  (
    WITH beside AS (
      SELECT word, pos, tok, lead(tok) OVER w AS next_tok, lead(pos) OVER w AS next_pos, row_number() OVER w AS n
      FROM recurring.state WHERE tok >= 0 AND word IN (SELECT word FROM state) WINDOW w AS (PARTITION BY word ORDER BY pos)
    ),
    pairs AS (SELECT b.word, b.pos, b.next_pos, b.n, m.merged, m.safe FROM beside b JOIN merges m ON m.lhs = b.tok AND m.rhs = b.next_tok),
    least AS (SELECT * FROM pairs QUALIFY merged = min(merged) OVER (PARTITION BY word)),
    runs AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n) AS k FROM least),
    chosen AS (
      SELECT * FROM runs QUALIFY CASE WHEN safe THEN row_number() OVER (PARTITION BY word, n - k ORDER BY n) % 2 = 1 ELSE k = 1 END
    )
    SELECT word, unnest([pos, next_pos]), unnest([merged, -1]) FROM chosen
  )
)
"""
#: Tokens of a word in the order of their places, as ids and as the bytes of the ids.
DECODED = """
SELECT word, array_to_string(ids, ' '), array_to_string(list_select(hex, list_transform(ids, lambda i: i + 1)), '')
FROM (
  SELECT word, list_transform(list_sort(list(pos::BIGINT << 24 | tok)), lambda placed: placed & 16777215) AS ids
  FROM state WHERE tok >= 0 GROUP BY word
) CROSS JOIN tokens
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, which are their ids, from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class WordCoder:
    """Encodes words into ids and decodes the ids, both in DuckDB; remembers a bounded number of words."""

    def __init__(self, rank_path: str, pattern: str):
        ranks = read_ranks(rank_path)
        self.words = regex.compile(pattern)
        hex_of = [""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            hex_of[rank] = token.hex()
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        # Every way to part a token into two tokens is a merge; its rank is the token's id.
        merges = [
            (ranks[token[:k]], ranks[token[k:]], merged)
            for token, merged in ranks.items() for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks
        ]
        lhs, rhs, merged = zip(*merges, strict=True) if merges else ((), (), ())
        least: dict[int, int] = {}  # per token, the lowest rank of a token made from it
        for a, b, m in merges:
            least[a], least[b] = min(m, least.get(a, m)), min(m, least.get(b, m))
        safe = [least.get(m, m) >= m for m in merged]
        self._fill("merges", pa.table({
            "lhs": pa.array(lhs, pa.int32()), "rhs": pa.array(rhs, pa.int32()), "merged": pa.array(merged, pa.int32()), "safe": pa.array(safe, pa.bool_()),
        }))
        self._fill("tokens", pa.table({"hex": pa.array([hex_of], pa.list_(pa.string()))}))  # one row: the bytes of every id
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}
        self.chars = 0

    def _fill(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _encode(self, words: list[str], data: list[bytes], query: str) -> None:
        sizes = np.array([len(d) for d in data])
        raw = np.frombuffer(b"".join(data), np.uint8)
        pos = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.db.register("start", pa.table({
            "word": np.repeat(np.arange(len(data), dtype=np.int32), sizes), "pos": pos.astype(np.int32), "tok": self.byte_ids[raw],
        }))
        for word, ids, decoded in self.db.execute(query + DECODED).fetchall():
            self.ids[words[word]], self.decoded[words[word]] = ids, bytes.fromhex(decoded)
            self.chars += len(words[word])
        self.db.unregister("start")

    def learn(self, words: set[str]) -> None:
        """Make sure that all of ``words`` are known; forgets the others when there are too many."""
        if len(self.ids) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.ids.clear()
            self.decoded.clear()
            self.chars = 0
        new = [(w, w.encode("utf-8")) for w in words if w not in self.ids]
        for query, wanted in ((SHORT_WORDS, False), (LONG_WORDS, True)):
            call, data, held = [], [], 0
            for word, raw in new:
                if (len(raw) > LONG_WORD) != wanted:
                    continue
                if call and held + len(raw) > CALL_BYTES:
                    self._encode(call, data, query)
                    call, data, held = [], [], 0
                call.append(word)
                data.append(raw)
                held += len(raw)
            if call:
                self._encode(call, data, query)

    def code(self, words: list[str]) -> tuple[int, str, bytes]:
        """Number of ids, ids as decimal text, and the bytes they decode to, of known words in a row."""
        ids = " ".join(map(self.ids.__getitem__, words))
        return ids.count(" ") + bool(ids), ids, b"".join(map(self.decoded.__getitem__, words))


@functools.lru_cache(maxsize=1)
def coder(rank_path: str, pattern: str) -> WordCoder:
    """The coder of this worker process."""
    return WordCoder(rank_path, pattern)


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids, decoded`` of every row: ids as decimal text parted by spaces, and their bytes.

    ``rank_path`` is a rank file that every node has (or ``sent:NAME`` for one sent with
    ``SparkContext.addFile``), ``pattern`` parts a text into words. A null text counts as
    empty and has no ids. Repeated rows are coded each; other columns are not read.
    """
    return _coded(docs, rank_path, pattern, key, text, "ids string, decoded binary", lambda ids, decoded: (ids, decoded))


def encode_digests(docs: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As :func:`encode_documents`, with SHA-256 digests in place of ids and bytes."""
    return _coded(
        docs, rank_path, pattern, key, text, "ids_sha256 string, decoded_sha256 string",
        lambda ids, decoded: (hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()),
    )


def _coded(docs: DataFrame, rank_path: str, pattern: str, key: str, text: str, fields: str, finish) -> DataFrame:
    chosen = docs.select(key, text)
    kinds = [pa.int64(), *(pa.binary() if f.split()[1] == "binary" else pa.string() for f in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(local_file(rank_path), pattern)
        for batch in slices(batches, text, SLICE_BYTES):
            texts = [own.words.findall(t or "") for t in column_of(batch, text)]
            own.learn({w for words in texts for w in words})
            rows = [(n, *finish(ids, decoded)) for n, ids, decoded in map(own.code, texts)]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "n_tokens", *(f.split()[0] for f in fields.split(", "))])

    return chosen.mapInArrow(run, f"`{key}` {chosen.schema[0].dataType.simpleString()}, n_tokens long, {fields}")

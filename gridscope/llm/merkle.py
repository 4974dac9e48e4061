"""A Merkle manifest of a table: one root, and a proof for every row.

Rows are leaves; the leaves of a group stand in the order of their keys, eight in a row form
a node, and the roots of the groups form one more tree. No sort finds a leaf's place. Every
group's keys are merged into a bitmap, stored as its non-empty 64-bit words, with a popcount
directory above them: the number of rows before each word, kept per word, per 2^16, 2^32 and
2^48 keys, so that no running sum spans more than 2^16 entries. A rank query, one look-up of
a word and one population count, gives the leaf's coordinate. Digests then meet in arrays
keyed by the coordinate without its last bits, and each array is reduced by several levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridscope.llm.common import staged

#: Children of a node, and levels that one array of slots is reduced by.
FAN_OUT, LEVELS = 8, 3
SLOTS = FAN_OUT**LEVELS
#: Bits of a key inside a word, and steps of the directory above words, in bits.
WORD_BITS, DIRECTORY = 6, (10, 16, 16, 16)
#: Words that hold this share of all rows or more are looked up by broadcast: they are fewer than its inverse.
HOT_SHARE = 1 / 2000
#: The word of rows without a key: below every other one.
NO_KEY = -(1 << 62)
PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field_text(value: Column) -> Column:
    """A cell as its number of UTF-8 bytes, a colon and its text; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_ascii(text: Column) -> Column:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, capitals, capitals.lower())


def leaves(docs: DataFrame, key: str, group: str, fields: list[str], tampered: dict[str, Column], tamper: Column) -> DataFrame:
    """``row, key, g, leaf, other``: the digest of every row and, where ``tamper`` holds, of its changed form.

    ``g`` is a text that orders groups as their values do, nulls first. Written once, so that
    ``row`` is the same for every reader.
    """
    def hashed(changes: dict[str, Column]) -> Column:
        return digest(F.concat(*[field_text(changes.get(f, F.col(f))) for f in fields]))

    return staged(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"),
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"),
        hashed({}).alias("leaf"), F.when(tamper, hashed(tampered)).alias("other"),
    ), "leaves")


def _word(key: Column) -> Column:
    return F.coalesce(F.shiftright(key, WORD_BITS), F.lit(NO_KEY))


def _bit(key: Column) -> Column:
    """The key's place in its word."""
    return F.coalesce(F.pmod(key, F.lit(1 << WORD_BITS)), F.lit(0)).cast("int")


def _one_bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bitmaps(rows: DataFrame) -> DataFrame:
    """``g, word, bits, n, before, total``: each group's bitmap with its popcount directory.

    ``n`` counts rows, repeated keys included; ``before`` those of the group in earlier words,
    and ``total`` all of them.
    """
    words = staged(
        rows.groupBy("g", _word(F.col("key")).alias("word")).agg(
            F.bit_or(_one_bit(_bit(F.col("key")))).alias("bits"), F.count(F.lit(1)).alias("n")
        ), "words",
    )
    # Bottom-up: rows per directory entry. Top-down: rows before it among its siblings, and before its parent.
    counted = [words.select("g", F.col("word").alias("at"), "n")]
    for bits in DIRECTORY[:-1]:
        counted.append(counted[-1].groupBy("g", F.shiftright("at", bits).alias("at")).agg(F.sum("n").alias("n")))
    above = counted[-1].groupBy("g").agg(F.sum("n").alias("total")).withColumns({"parent": F.lit(0).cast("long"), "base": F.lit(0).cast("long")})
    for level in range(len(DIRECTORY) - 1, -1, -1):
        entry = counted[level]
        parent = F.shiftright("at", DIRECTORY[level]) if level < len(DIRECTORY) - 1 else F.lit(0)
        siblings = Window.partitionBy("g", "parent").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        entry = entry.withColumn("parent", parent.cast("long")).withColumn("inside", F.coalesce(F.sum("n").over(siblings), F.lit(0)))
        placed = entry.join(above, ["g", "parent"]).select("g", "at", (F.col("base") + F.col("inside")).alias("base"), "total")
        above = placed.withColumnRenamed("at", "parent")
    return words.join(above.withColumnRenamed("parent", "word"), ["g", "word"]).withColumnRenamed("base", "before")


def _among_equals(rows: DataFrame) -> DataFrame:
    """``row, inside``: places of rows in words with repeated keys, by key, digest and row.

    Counted per 16 bits of the digest, then per digest and part of the staged table, then by
    row inside that part: a key or a row repeated very often is spread over all of these.
    """
    rows = rows.select(
        "row", "g", _word(F.col("key")).alias("word"), _bit(F.col("key")).alias("bit"), F.substring("leaf", 1, 4).alias("head"), "leaf",
        F.shiftright("row", 33).alias("part"),
    )
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("g", "word", "bit", "head", "leaf", "part").agg(F.count(F.lit(1)).alias("n"))
    heads = parts.groupBy("g", "word", "bit", "head").agg(F.sum("n").alias("n")).withColumn(
        "first", F.coalesce(F.sum("n").over(before(["g", "word"], ["bit", "head"])), F.lit(0))
    ).drop("n")
    parts = parts.withColumn("second", F.coalesce(F.sum("n").over(before(["g", "word", "bit", "head"], ["leaf", "part"])), F.lit(0))).drop("n")
    own = Window.partitionBy("g", "word", "bit", "leaf", "part").orderBy("row")
    return (
        rows.withColumn("third", F.row_number().over(own) - 1)
        .join(parts, ["g", "word", "bit", "head", "leaf", "part"]).join(heads, ["g", "word", "bit", "head"])
        .select("row", (F.col("first") + F.col("second") + F.col("third")).alias("inside"))
    )


def coordinates(rows: DataFrame) -> DataFrame:
    """``rows`` with ``idx``, the place in the group from 0, and ``total``, the group's size. Written once.

    Rows without a key come first; equal keys stand by digest, equal rows in any fixed order.
    """
    words = staged(bitmaps(rows), "bitmaps")
    facts = words.agg(F.sum("n").alias("n"), F.count_if(F.bit_count("bits") < F.col("n")).alias("loose")).first()
    hot = staged(words.where(F.col("n") >= F.lit(HOT_SHARE * (facts["n"] or 0))).where(F.col("n") > (1 << WORD_BITS)), "hot-words")
    keyed = rows.withColumn("word", _word(F.col("key")))
    if hot.isEmpty():
        found = keyed.join(words, ["g", "word"])
    else:
        few = F.broadcast(hot)  # fewer than 1 / HOT_SHARE words can hold that share of the rows each
        found = keyed.join(few, ["g", "word"]).unionByName(
            keyed.join(few, ["g", "word"], "left_anti").join(words.join(few, ["g", "word"], "left_anti"), ["g", "word"])
        )
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), _bit(F.col("key"))))
    lower = F.bit_count(F.col("bits").bitwiseAND(below))
    loose = F.bit_count("bits") < F.col("n")
    placed = found.withColumn("idx", F.col("before") + lower)
    columns = [*rows.columns, "idx", "total"]
    if not facts["loose"]:
        return staged(placed.select(columns), "placed")
    placed = staged(placed.withColumn("loose", loose), "placed-loosely")
    inside = _among_equals(placed.where("loose").select(rows.columns))
    again = placed.where("loose").join(inside, "row").withColumn("idx", F.col("before") + F.col("inside"))
    return staged(placed.where("not loose").select(columns).unionByName(again.select(columns)), "placed")


def _height(total: Column) -> Column:
    """Levels from ``total`` nodes to one."""
    levels = F.lit(0)
    for k in range(21):
        levels = levels + (total > F.lit(FAN_OUT**k)).cast("int")
    return levels


def _reduced(level: Column) -> Column:
    """The parents of an array of consecutive nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN_OUT).cast("int"))
    return F.transform(runs, lambda k: digest(F.array_join(F.slice(level, k * FAN_OUT + 1, FAN_OUT), "")))


def _blocks(nodes: DataFrame, tier: int, carry: list[str]) -> DataFrame:
    """Arrays of up to :data:`SLOTS` consecutive nodes ``g, idx, total, hash``, with their levels above.

    ``g, block, total, levels, items, l0..l3``: ``levels`` tells how many of the arrays count,
    ``items`` holds ``carry`` of each node.
    """
    slot = F.struct(F.pmod("idx", F.lit(SLOTS)).cast("int").alias("slot"), F.col("hash"), *[F.col(c) for c in carry])
    blocks = nodes.groupBy("g", F.floor(F.col("idx") / SLOTS).alias("block")).agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(slot)).alias("slots")
    )
    blocks = blocks.withColumn("levels", F.least(F.lit(LEVELS), F.greatest(F.lit(0), _height(F.col("total")) - F.lit(tier * LEVELS))))
    blocks = blocks.withColumn("l0", F.transform("slots", lambda s: s["hash"]))
    for k in range(LEVELS):
        blocks = blocks.withColumn(f"l{k + 1}", F.when(F.col("levels") > k, _reduced(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
    items = [F.transform("slots", lambda s: F.struct(*[s[c].alias(c) for c in carry])).alias("items")] if carry else []
    return staged(blocks.select("g", "block", "total", "levels", *items, *[f"l{k}" for k in range(LEVELS + 1)]), f"tier-{tier}")


def _tree(nodes: DataFrame, most: int, carry: list[str]) -> list[DataFrame]:
    """The tiers of blocks over ``nodes``, of which no group has more than ``most``; the last has one node per group."""
    tiers = [_blocks(nodes, 0, carry)]
    while most > SLOTS:
        most = -(-most // SLOTS)
        up = tiers[-1].select("g", F.col("block").alias("idx"), "total", F.element_at(f"l{LEVELS}", 1).alias("hash"))
        tiers.append(_blocks(up, len(tiers), []))
    return tiers


def _own_path(place: Column) -> Column:
    """Texts left and right of a node of a block, level by level."""
    steps = []
    for k in range(LEVELS):
        at = F.floor(place / FAN_OUT**k).cast("int")
        run, level = at - F.pmod(at, F.lit(FAN_OUT)), F.col(f"l{k}")
        steps.append(F.struct(
            F.array_join(F.slice(level, run + 1, at - run), "").alias("left"),
            F.array_join(F.slice(level, at + 2, run + FAN_OUT - 1 - at), "").alias("right"),
        ))
    return F.slice(F.array(*steps), 1, F.col("levels"))


def _paths(tiers: list[DataFrame], tops: DataFrame, shared: list[str]) -> DataFrame:
    """``g, idx, path, item`` and ``shared`` of every node of the lowest tier; ``tops`` has ``g, above`` and ``shared``."""
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for tier in reversed(tiers):
        joined = tier.join(above, ["g", "block"])
        each = joined.select(
            "g", "block", "levels", "above", *(["items"] if tier is tiers[0] else []), *shared, *[f"l{k}" for k in range(LEVELS + 1)], F.posexplode("l0").alias("place", "hash")
        )
        path = F.concat(_own_path(F.col("place")), F.col("above"))
        item = [F.get("items", F.col("place")).alias("item")] if tier is tiers[0] else []
        nodes = each.select("g", (F.col("block") * SLOTS + F.col("place")).alias("idx"), path.alias("path"), "hash", *shared, *item)
        above = nodes.select("g", F.col("idx").alias("block"), F.col("path").alias("above"), *shared)
    return nodes


def _numbered(groups: DataFrame) -> DataFrame:
    """``groups`` (``g, hash``) with ``idx`` in the order of ``g``: sorted ranges, and the sizes of those before."""
    ranged = staged(
        groups.repartitionByRange("g").sortWithinPartitions("g").withColumn("id", F.monotonically_increasing_id()), "groups"
    ).withColumn("part", F.shiftright("id", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("m")).select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    within = F.col("id") - F.call_function("shiftleft", F.col("part"), F.lit(33))
    return ranged.join(starts, "part").select("g", "hash", (F.col("start") + within).alias("idx"))


def manifest(rows: DataFrame) -> DataFrame:
    """``key, leaf, subroot, root, path, other`` of the ``leaves`` ``rows``, duplicates included.

    ``path`` lists the siblings' digests left and right of the leaf and its ancestors, bottom-up.
    """
    placed = coordinates(rows)
    most = placed.agg(F.max("total").alias("m")).first()["m"] or 0
    tiers = _tree(placed.withColumnRenamed("leaf", "hash"), most, ["key", "other"])
    subroots = staged(_numbered(tiers[-1].select("g", F.element_at(f"l{LEVELS}", 1).alias("hash"))), "subroots")
    n_groups = subroots.count()
    over = subroots.select(F.lit("").alias("g"), "idx", F.lit(n_groups).cast("long").alias("total"), "hash", F.col("g").alias("group"))
    group_tiers = _tree(over, n_groups, ["group"])
    top = group_tiers[-1].select("g", F.element_at(f"l{LEVELS}", 1).alias("root"), F.array().cast(PATH).alias("above"))
    of_groups = _paths(group_tiers, top, ["root"])
    tops = of_groups.select(F.col("item.group").alias("g"), F.col("path").alias("above"), F.col("hash").alias("subroot"), "root")
    return _paths(tiers, tops, ["subroot", "root"]).select(
        F.col("item.key").alias("key"), F.col("hash").alias("leaf"), "subroot", "root", "path", F.col("item.other").alias("other"),
    )


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf's digest and the digests beside its path give."""
    return F.aggregate(path, leaf, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def proofs(
    docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tampered: dict[str, Column] | None = None, tamper: Column | None = None,
) -> DataFrame:
    """Per row: ``key, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``docs`` needs an integer ``key``, a ``group`` and the ``fields`` a leaf is made of; other
    columns are not read. Null fields count as such; null groups form the first group, and
    rows without a key come first in their group. Rows that repeat a key are leaves each,
    ordered by digest; equal rows have equal leaves and each its own place. ``tampered`` maps
    fields to changed values, which rows with ``tamper`` show to the verifier: their
    ``folded_root`` comes from the changed leaf and the original siblings. A row without a key
    is not tampered with unless ``tamper`` holds for it. An empty table gives no rows.
    """
    changed = F.coalesce(tamper, F.lit(False)) if tamper is not None else F.lit(False)
    told = manifest(leaves(docs, key, group, list(fields), tampered or {}, changed))
    beside = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    told = told.select(
        F.col("key").alias(key), "leaf", "subroot", "root", digest(beside).alias("proof_sha256"),
        folded(F.col("path"), F.coalesce("other", "leaf")).alias("folded_root"),
    )
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def reference_sql() -> str:
    """The registered query's result on ``documents``, in DuckDB SQL."""
    def leaf(text: str) -> str:
        cells = ["doc_id", "source", "lang", "n_chars", text]
        return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in cells) + ")"

    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE bits(x, b, k) AS (
  SELECT x::BIGINT, x::BIGINT, 0 FROM range(256) AS t(x)
  UNION ALL
  SELECT x, CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END, k + 1 FROM bits WHERE k < 8
),
crc(doc_id, s, k, a) AS (
  SELECT doc_id, doc_id::VARCHAR, 1, 4294967295 FROM documents
  UNION ALL
  SELECT c.doc_id, c.s, c.k + 1, xor(c.a // 256, t.b)
  FROM crc c JOIN bits t ON t.k = 8 AND t.x = xor(c.a, ord(substr(c.s, c.k, 1))::BIGINT) % 256 WHERE c.k <= length(c.s)
),
d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf("text")} AS leaf, {leaf(f"translate(text, '{capitals}', '{capitals.lower()}')")} AS other,
         xor(c.a, 4294967295) % 3 = 0 AS tamper
  FROM documents JOIN crc c USING (doc_id) WHERE c.k = length(c.s) + 1
),
low(lvl, g, idx, h, n) AS (
  SELECT 0, g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1, leaf, count(*) OVER (PARTITION BY g) FROM d
  UNION ALL
  SELECT lvl + 1, g, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM low WHERE n > 1 GROUP BY lvl, g, idx // 8, n
),
subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high(lvl, idx, h, n) AS (
  SELECT 0, idx, h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM high WHERE n > 1 GROUP BY lvl, idx // 8, n
),
low_runs AS (SELECT lvl, g, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM low WHERE n > 1 GROUP BY lvl, g, idx // 8),
high_runs AS (SELECT lvl, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM high WHERE n > 1 GROUP BY lvl, idx // 8),
start AS (
  SELECT doc_id, g, leaf, CASE WHEN tamper THEN other ELSE leaf END AS shown, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS idx FROM d
),
climb(doc_id, g, lvl, idx, acc, beside) AS (
  SELECT doc_id, g, 0, idx, shown, '' FROM start
  UNION ALL
  SELECT c.doc_id, c.g, c.lvl + 1, c.idx // 8,
         sha256(array_to_string(r.hs[:c.idx % 8], '') || c.acc || array_to_string(r.hs[c.idx % 8 + 2:], '')),
         c.beside || array_to_string(r.hs[:c.idx % 8], '') || array_to_string(r.hs[c.idx % 8 + 2:], '')
  FROM climb c JOIN low_runs r ON r.lvl = c.lvl AND r.g = c.g AND r.run = c.idx // 8
),
mid AS (SELECT * FROM climb QUALIFY lvl = max(lvl) OVER (PARTITION BY doc_id)),
over_groups(doc_id, lvl, idx, acc, beside) AS (
  SELECT m.doc_id, 0, s.idx, m.acc, m.beside FROM mid m JOIN subroots s USING (g)
  UNION ALL
  SELECT c.doc_id, c.lvl + 1, c.idx // 8,
         sha256(array_to_string(r.hs[:c.idx % 8], '') || c.acc || array_to_string(r.hs[c.idx % 8 + 2:], '')),
         c.beside || array_to_string(r.hs[:c.idx % 8], '') || array_to_string(r.hs[c.idx % 8 + 2:], '')
  FROM over_groups c JOIN high_runs r ON r.lvl = c.lvl AND r.run = c.idx // 8
),
done AS (SELECT * FROM over_groups QUALIFY lvl = max(lvl) OVER (PARTITION BY doc_id))
SELECT s.doc_id, s.leaf, sr.h AS subroot, t.h AS root, sha256(f.beside) AS proof_sha256, f.acc AS folded_root, f.acc = t.h AS verified
FROM start s JOIN subroots sr USING (g) JOIN done f USING (doc_id) CROSS JOIN (SELECT h FROM high WHERE n = 1) AS t
"""

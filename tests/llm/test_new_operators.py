"""Toxicity, lexical search and the Merkle manifest against plain versions, and on hard cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscope.llm import lexical_search, merkle, toxicity

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, key long, g string, row long, item string, term string"


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows and keys, negative keys and clashing names."""
    more = (1, "g", 2, "i", "t")
    long = " ".join(random.Random(5).choice(["alpha", "beta", "gamma", "delta"]) + str(k % 900) for k in range(60_000))
    rows = [
        (1, "Alpha beta. Gamma!", "en", "a", 3, *more), (1, "Alpha beta. Gamma!", "en", "a", 3, *more), (1, "alpha BETA", "en", "b", 3, *more),
        (None, "alpha", "en", None, None, *more), (None, None, None, None, None, *[None] * 5), (None, None, None, None, None, *[None] * 5),
        (2, "", "de", "a", 0, *more), (3, long, "de", "a", len(long), *more), (-7, "gamma delta é日本", "de", "a", 5, *more),
        (2**40, "beta beta delta1", None, "a", 5, *more), (-(2**62), "delta", "", "a", 5, *more), (4, "!!! ...", "fr", "a", 7, *more),
    ]
    rows += [(100 + k, f"alpha word{k}", "en", "s", k, *more) for k in range(700)]
    rows += [(5, "copy", "en", "s", 1, *more)] * 90 + [(6, f"other {k}", "en", "s", 1, *more) for k in range(90)]
    return spark.createDataFrame(rows, FIELDS).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], FIELDS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    cells = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k : k + 8])) for k in range(0, len(last), 8)])
    return levels


def climb(levels, at, node):
    beside = ""
    for level in levels[:-1]:
        run = at - at % 8
        left, right = "".join(level[run:at]), "".join(level[at + 1 : run + 8])
        node, beside, at = sha(left + node + right), beside + left + right, at // 8
    return node, beside


def plain_manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        shown = r["text"]
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and shown is not None:
            shown = re.sub("[A-Z]", lambda m: m.group().lower(), shown)
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), leaf_of(r, shown), r["doc_id"]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = levels_of([x[2] for x in groups[g]])
    top = levels_of([trees[g][-1][0] for g in names])
    out = []
    for n, g in enumerate(names):
        for at, (_, _, leaf, shown, doc_id) in enumerate(groups[g]):
            node, beside = climb(trees[g], at, shown)
            node, more = climb(top, n, node)
            out.append((str(doc_id), leaf, trees[g][-1][0], top[-1][0], sha(beside + more), node, node == top[-1][0]))
    return sorted(out)


def told_manifest(docs):
    tamper = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = merkle.proofs(docs, tampered={"text": merkle.lower_ascii(F.col("text"))}, tamper=tamper)
    return sorted((str(r[0]), *r[1:]) for r in found.collect())


def test_manifest_of_hard_cases(hard):
    assert told_manifest(hard) == plain_manifest([r.asDict() for r in hard.collect()])


def test_manifest_with_a_hot_key(spark):
    """A third of all rows repeats one key, half of them as equal rows: a hot word, looked up by broadcast."""
    rows = [(7, "same", "en", "a", 1)] * 1500 + [(7, f"Text {k}", "en", "a", 1) for k in range(1500)] + [(20 + k, "x", "en", "a", 1) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert told_manifest(docs) == plain_manifest([r.asDict() for r in docs.collect()])


def test_manifest_of_one_and_no_row(spark, nothing):
    one = spark.createDataFrame([(5, "T", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    row = merkle.proofs(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["verified"] and row["proof_sha256"] == sha("")
    assert merkle.proofs(nothing).count() == 0


def test_manifest_of_many_groups(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("T"), "id").alias("text"), (F.col("id") % 1100).cast("string").alias("lang"),
        F.lit("s").alias("source"), F.col("id").alias("n_chars"),
    )
    assert told_manifest(docs) == plain_manifest([r.asDict() for r in docs.collect()])


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k=10):
    def terms(text):
        return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))

    held = [(d, collections.Counter(terms(t))) for d, t in docs]
    n, tokens = sum(1 for _, c in held if c), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            m = 10 + (90 * c.total() * n) // tokens if tokens else 10
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t]
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(map(str, out))


def told_search(docs, items):
    found = lexical_search.search(lexical_search.index(docs), items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(str(tuple(r)) for r in found.collect())


def test_search_of_hard_cases(spark, hard, nothing):
    items = spark.createDataFrame(
        [(1, "alpha Beta"), (2, None), (3, ""), (4, "gamma copy copy word3"), (5, "nowhere"), (6, "é日本 delta899 word699"), (None, "other 7"), (6, "alpha")],
        "item_id long, text string",
    )
    docs = [(r["doc_id"], r["text"]) for r in hard.collect()]
    assert told_search(hard, items) == plain_search(docs, [tuple(r) for r in items.collect()])
    assert told_search(nothing, items) == [] and told_search(hard, items.limit(0)) == []


def test_search_in_many_segments_and_blocks(spark, monkeypatch):
    draw = random.Random(3)
    words = [f"w{int(draw.paretovariate(0.6)) % 500}" for _ in range(3000)]
    docs = [(k, " ".join(draw.choices(words, k=draw.randint(1, 90)))) for k in range(2500)] + [(9000 + k, "w1 w2 w3") for k in range(40)]
    items = [(k, " ".join(draw.choices(words, k=12))) for k in range(25)]
    monkeypatch.setattr(lexical_search, "SEGMENT_BYTES", 20_000)
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 300)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = told_search(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert found == plain_search(docs, items)


def test_search_looks_at_few_documents():
    """The bounds leave most documents unscored."""
    draw = random.Random(4)
    held = [draw.choices(range(300), k=40) for _ in range(2000)]
    numbers = {f"t{k}": k for k in range(300)}
    postings = collections.Counter((t, d) for d, terms in enumerate(held) for t in terms)
    order = sorted(postings)
    row = {
        "keys": np.arange(2000).tobytes(), "lengths": np.full(2000, 40).tobytes(), "terms": list(numbers),
        "dfs": np.bincount([t for t, _ in order], minlength=300).astype("<u4").tobytes(),
        "places": np.array([d for _, d in order], "<u4").tobytes(), "tfs": np.array([postings[p] for p in order], "<u4").tobytes(),
    }
    segment = lexical_search.Segment(row, dict.fromkeys(numbers, 3000), (2000, 80_000))
    seen = []
    plain = segment.scores
    segment.scores = lambda terms, place: seen.extend(place) or plain(terms, place)
    best = segment.search(["t1", "t2", "t3"], [], 10)
    everything = plain(np.arange(3) + 1, np.arange(2000))
    assert best == sorted((-s, d) for d, s in enumerate(everything.tolist()))[:10]
    assert len(seen) < 700 and len(set(seen)) == len(seen)


def test_noisy_or_and_places():
    weights = np.zeros(toxicity.BUCKETS, np.float32)
    weights[toxicity.buckets_of("vile")[0]] = 6.0
    model = toxicity.ToxicityModel(weights, -4.0)
    text = "Nice words here. You VILE thing! More. vile vile"
    score, found = toxicity.judged(text, model.bias, toxicity.word_weights(model), 0.3)
    chance = lambda s: 1 / (1 + math.exp(-s))
    assert score == pytest.approx(1 - (1 - chance(-4)) ** 2 * (1 - chance(2)) * (1 - chance(8)))
    assert [text[s["start"] : s["start"] + s["length"]].strip() for s in found] == ["You VILE thing", "vile vile"]


def test_gradient_fits_document_labels():
    """Only documents are labelled; the words that make them toxic are found, and the sentence that holds them."""
    draw, rows = random.Random(1), []
    for k in range(400):
        sentences = [" ".join(f"w{draw.randint(0, 300)}" for _ in range(8)) for _ in range(6)]
        if k % 4 == 0:
            sentences[draw.randint(0, 5)] += " " + draw.choice(["slur", "curse"])
        rows.append((". ".join(sentences), k % 4 == 0))
    words, starts = [], []
    for text, _ in rows:
        held, begins, _ = toxicity.instances(text)
        each = [toxicity.buckets_of(w) for w in held]
        words.append(np.array([b for e in each for b in e], np.int32))
        starts.append(np.cumsum([0, *map(len, each)])[begins])
    model = toxicity.fit_weights(words, starts, np.array([y for _, y in rows]))
    known = toxicity.word_weights(model)
    told = [toxicity.judged(text, model.bias, known, 0.3) for text, _ in rows]
    assert np.mean([(s >= 0.3) == y for (s, _), (_, y) in zip(told, rows, strict=True)]) > 0.97
    for (text, toxic), (_, found) in zip(rows, told, strict=True):
        if toxic:
            assert any(re.search("slur|curse", text[f["start"] : f["start"] + f["length"]]) for f in found)


def test_toxicity_of_hard_cases(spark, hard, nothing):
    labels = spark.createDataFrame([(k, int(k % 2 == 0), 1) for k in range(100, 400)] + [(None, 1, 0), (101, None, 0), (5, 0, 0)], "doc_id long, toxic int, text int")
    model = toxicity.fit(hard, labels, ~toxicity.held_out())
    rows = toxicity.score(hard, model).collect()
    assert len(rows) == hard.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] == 2} == {0.0} and {r["score"] for r in rows if r["doc_id"] == 4} == {0.0}
    assert toxicity.score(nothing, model).count() == 0
    for none in (toxicity.fit(nothing, labels, F.lit(True)), toxicity.fit(hard, labels.limit(0), F.lit(True))):
        assert max(r["score"] for r in toxicity.score(hard, none).collect()) < 1e-6


def test_toxicity_on_held_out_documents(spark):
    """Documents whose labels were not learned from: most toxic ones are caught, clean ones left alone."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    told = toxicity.score(docs.where(toxicity.held_out()), model).join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = collections.Counter({(r["toxic"], r["predicted"]): r["count"] for r in told})
    assert n[1, 1] / (n[1, 0] + n[1, 1]) > 0.88 and n[0, 0] / (n[0, 0] + n[0, 1]) > 0.98

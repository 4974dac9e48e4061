"""What a worker that Spark uses again keeps of earlier tasks."""

import gc

import pyarrow as pa
import public_tokenizers

from gridscope.llm import common, jaccard_join, language_id, packing


def chunks_held():
    gc.collect()
    return sum(isinstance(o, packing.ChunkIds) for o in gc.get_objects())


def taken(monkeypatch, df, build):
    """The function that ``build`` hands to ``mapInArrow``."""
    found = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, *more: found.append(run) or self)
    build(df)
    monkeypatch.undo()
    return found[0]


def test_other_operators_free_the_remembered_chunks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some words and others")], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    batch = pa.RecordBatch.from_pydict({"row": [0], "doc_id": [1], "text": ["some words and others"]})
    pieces = taken(monkeypatch, docs, lambda d: packing.pieces_of(d, path))
    model = language_id.LanguageModel([], language_id.np.zeros(0, int), language_id.np.zeros(0), language_id.np.zeros((language_id.BUCKETS, 0)), language_id.np.zeros(language_id.BUCKETS))
    others = [
        language_id._document_frequencies,
        taken(monkeypatch, docs, lambda d: language_id.identify(d, model)),
    ]
    for other in others:
        list(pieces(iter([batch])))
        first = common.kept(packing.ChunkIds, path)
        list(pieces(iter([batch])))
        assert common.kept(packing.ChunkIds, path) is first  # tasks of one kind share it
        del first
        assert chunks_held() == 1
        list(other(iter([])))
        assert chunks_held() == 0


def test_keys_beside_a_null_stay_whole(spark):
    """Integers beyond 2**53 are no floats, also where a key is missing."""
    text, near = " ".join(f"w{k}" for k in range(80)), " ".join(f"w{k}" for k in range(79))
    rows = [(2**53 + 3, text), (2**53 + 1, near), (None, "something else altogether"), (2**60 + 1, None)]
    stored = common.staged(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "large-keys")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(stored).collect()}
    assert got == {(2**53 + 3, 78, 2**53 + 1), (2**53 + 1, 77, 2**53 + 1), (None, 1, None), (2**60 + 1, 0, 2**60 + 1)}
    kept = {r["doc_id"] for r in jaccard_join.without_near_duplicates(stored).collect()}
    assert kept == {2**53 + 1, None, 2**60 + 1}

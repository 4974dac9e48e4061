"""Language identification by nearest centroid.

A text becomes a vector of hashed letter n-grams, weighted by TF-IDF and scaled to length one.
Each language has several centroids, found by clustering vectors of a bounded sample of
labelled rows. A text takes the language of the centroid with the highest cosine, and is
rejected when it lies too far from it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from gridscope.llm.common import column_of, crc_share, forget, slices

UNDETERMINED = "und"
BUCKETS = 1 << 15
ORDERS = (2, 3)

#: Bytes of a lower-cased text: ASCII characters that are not letters all count as a space.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass(frozen=True)
class LanguageModel:
    """What prediction needs; its size is ``languages * clusters * BUCKETS`` at most."""

    languages: list[str]
    #: Per centroid: the index of its language, and the least cosine it accepts.
    owner: np.ndarray
    radius: np.ndarray
    #: One row per n-gram bucket, one column per centroid.
    centroids: np.ndarray
    idf: np.ndarray


def has_letter(text: str) -> bool:
    return next((True for c in text if c.isalpha()), False)


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams in a text, and how often each occurs. N-grams of spaces only are left out."""
    squeezed = b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())
    data = np.frombuffer(b" " + squeezed + b" ", np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for order in ORDERS:
        if len(data) < order + 1:
            continue
        code = np.full(len(data) - order + 1, order, np.uint32)
        for k in range(order):
            code = (code ^ data[k : len(data) - order + 1 + k]) * np.uint32(0x9E3779B1)
        counts += np.bincount((code >> np.uint32(17)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weights(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of a text's buckets, scaled to length one."""
    raw = (1.0 + np.log(counts)) * idf[at]
    length = np.sqrt((raw * raw).sum())
    return (raw / length if length else raw).astype(np.float32)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    seen, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in slices(batches, "text"):
        for text in column_of(batch, "text"):
            if text is not None and has_letter(text):
                seen[term_counts(text)[0]] += 1
                rows += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_pydict({
        "bucket": pa.array(np.append(at, -1), pa.int32()), "df": pa.array(np.append(seen[at], rows), pa.int64()),
    })


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        keep, at_bytes, count_bytes = [], [], []
        for k, text in enumerate(column_of(batch, "text")):
            if has_letter(text):
                at, counts = term_counts(text)
                keep.append(k)
                at_bytes.append(at.astype(np.int32).tobytes())
                count_bytes.append(np.minimum(counts, 2**31 - 1).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_pydict({
            "lang": batch.column(batch.schema.get_field_index("lang")).take(pa.array(keep, pa.int64())),
            "draw": batch.column(batch.schema.get_field_index("draw")).take(pa.array(keep, pa.int64())),
            "at": pa.array(at_bytes, pa.binary()), "counts": pa.array(count_bytes, pa.binary()),
        })


def _spread_seeds(vectors: np.ndarray, clusters: int, draw: np.random.Generator) -> list[int]:
    """Rows drawn one after another with the chance of their squared distance to those drawn before."""
    seeds = [int(draw.integers(len(vectors)))]
    nearest = vectors @ vectors[seeds[0]]
    while len(seeds) < min(clusters, len(vectors)):
        far = np.maximum(0.0, 1.0 - nearest).astype(np.float64)  # half the squared distance of vectors of length one
        if far.sum() <= 1e-6:
            break  # all rows are like a seed
        seeds.append(int(draw.choice(len(vectors), p=far / far.sum())))
        nearest = np.maximum(nearest, vectors @ vectors[seeds[-1]])
    return seeds


def cluster(
    vectors: np.ndarray, clusters: int, rounds: int = 10, least_share: float = 0.05, seed: int = 7
) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids of length one and each row's centroid.

    Seeds are drawn by distance. A centroid that ends with less than ``least_share`` of the
    rows stands for outliers: it starts again at a row drawn from the largest cluster, and
    after as many new starts as there are clusters it is dropped.
    """
    draw = np.random.default_rng(seed)
    centers = vectors[_spread_seeds(vectors, clusters, draw)].copy()
    least = least_share * len(vectors)

    def settle() -> np.ndarray:
        for _ in range(rounds):
            member = np.argmax(vectors @ centers.T, axis=1)
            for k in range(len(centers)):
                total = vectors[member == k].sum(axis=0)
                length = np.linalg.norm(total)
                if length:
                    centers[k] = total / length
        return np.argmax(vectors @ centers.T, axis=1)

    member = settle()
    for _ in range(clusters):
        sizes = np.bincount(member, minlength=len(centers))
        small = np.flatnonzero(sizes < least)
        if not len(small):
            break
        crowd = np.flatnonzero(member == np.argmax(sizes))
        centers[small] = vectors[draw.choice(crowd, size=len(small))]
        member = settle()
    while len(centers) > 1 and (sizes := np.bincount(member, minlength=len(centers))).min() < least:
        centers = np.delete(centers, np.argmin(sizes), axis=0)
        member = settle()
    return centers, member


def fit(
    docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", order_by: str = "doc_id",
    clusters: int = 4, sample_per_language: int = 400, slack: float = 0.25, quantile: float = 0.01, max_languages: int = 1000,
) -> LanguageModel:
    """Learn centroids from the rows where ``learn`` holds and text and language are not null.

    Document frequencies cover all of these rows. Clustering uses a sample, drawn by a hash
    of ``order_by`` and the text, whose expected size is ``sample_per_language`` per language
    and whose hard bound is twice that times the number of languages. Null and repeated keys
    are thus told apart by their texts; equal rows are drawn together. A centroid accepts
    texts whose cosine is at least ``slack`` times the ``quantile`` of its own members'
    cosines. The model grows with the languages; more than ``max_languages`` are an error.
    """
    spark = docs.sparkSession
    rows = docs.where(learn & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"),
        F.pmod(F.xxhash64(F.col(order_by), F.col(text), F.lit("language sample")), F.lit(1 << 30)).alias("draw"),
    )
    frequencies = (
        rows.select("text").mapInArrow(_document_frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    )
    idf, total = np.zeros(BUCKETS), 0
    for bucket, df in frequencies.collect():  # BUCKETS + 1 rows at most
        if bucket < 0:
            total = df
        else:
            idf[bucket] = df
    idf = np.log((1.0 + total) / (1.0 + idf)) + 1.0
    per_language = rows.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(per_language) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not per_language:
        return LanguageModel([], np.zeros(0, int), np.zeros(0), np.zeros((BUCKETS, 0), np.float32), idf)
    shares = spark.createDataFrame(
        [(r["lang"], int(min(1.0, sample_per_language / r["count"]) * (1 << 30))) for r in per_language], "lang string, below long"
    )
    bound = 2 * sample_per_language * len(per_language)
    drawn = (
        rows.join(F.broadcast(shares), "lang").where(F.col("draw") < F.col("below")).select("text", "lang", "draw")
        .mapInArrow(_sample_terms, "lang string, draw long, at binary, counts binary")
        .orderBy("draw", "lang", "at", "counts").limit(bound)
    )

    def centroids_of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["draw", "at", "counts"])
        vectors = np.zeros((len(group), BUCKETS), np.float32)
        for k, (at, counts) in enumerate(zip(group["at"], group["counts"], strict=True)):
            at = np.frombuffer(at, np.int32)
            vectors[k, at] = weights(at, np.frombuffer(counts, np.int32), idf)
        centers, member = cluster(vectors, clusters)
        near = (vectors * centers[member]).sum(axis=1)
        return pd.DataFrame([
            {"lang": group["lang"].iloc[0], "center": centers[k].tobytes(), "radius": float(slack * np.quantile(near[member == k], quantile))}
            for k in range(len(centers)) if (member == k).any()
        ])

    found = sorted(
        drawn.groupBy("lang").applyInPandas(centroids_of, "lang string, center binary, radius double").collect(),
        key=lambda r: (r["lang"], bytes(r["center"])),
    )
    languages = sorted({r["lang"] for r in found})
    return LanguageModel(
        languages,
        np.array([languages.index(r["lang"]) for r in found], int),
        np.array([r["radius"] for r in found]),
        np.stack([np.frombuffer(r["center"], np.float32) for r in found], axis=1) if found else np.zeros((BUCKETS, 0), np.float32),
        idf,
    )


def predict(model: LanguageModel, text: str | None) -> tuple[str, float, bool]:
    """Language, cosine of the nearest centroid, and whether it lies too far away."""
    if text is None or not len(model.owner) or not has_letter(text):
        return UNDETERMINED, 0.0, True
    at, counts = term_counts(text)
    cosines = weights(at, counts, model.idf) @ model.centroids[at]
    best = int(np.argmax(cosines))
    score = float(min(1.0, max(0.0, cosines[best])))
    return model.languages[model.owner[best]], score, score < model.radius[best]


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``lang_rejected``.

    A null text and a text without any letter are ``und`` with score 0 and rejected, as is
    every text when nothing could be learned. Texts too far from their nearest centroid keep
    its language and are rejected. Other columns pass through, whatever their names; columns
    named like the three results are replaced. Texts are read whole.
    """
    kept = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score", "lang_rejected")])
    frozen = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own = pickle.loads(frozen.value)
        for batch in slices(batches, text, 4 << 20):
            lang, score, rejected = zip(*[predict(own, t) for t in column_of(batch, text)], strict=True)
            told = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([bool(r) for r in rejected], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], names=[*batch.schema.names, "lang_pred", "score", "lang_rejected"])

    fields = StructType([*kept.schema.fields]).add("lang_pred", "string").add("score", "double").add("lang_rejected", "boolean")
    return kept.mapInArrow(run, fields)


def held_out(key: str = "doc_id", parts: int = 3) -> Column:
    return crc_share(key, parts) == F.lit(1)

"""Language by the nearest centroid.

A text is a TF-IDF vector of hashed byte bigrams and trigrams of its lower-cased letters (other
characters count as one blank), scaled to length 1. Each language has several centroids, found by
spherical k-means over a bounded sample of its labelled documents; a text takes the language of the
centroid with the largest cosine, and that cosine is its score. A text that is farther from every
centroid than ``1 - min_score`` of that centroid's language is rejected. ``min_score`` is a quarter (``SHARE``)
of the cosine that all but ``LOW`` of the language's labelled documents reach with its centroids, over all
of them, so text like the labelled documents stays and a few odd ones do not decide.

The fit is bounded by ``per_language`` documents of each language (smallest hash of the id, whatever the
length), and by ``SAMPLE_ROWS`` in all as long as that leaves each language one per centroid; any number of
languages is learned. Whole texts are counted in the tasks; only the counts go to the driver. Prediction
reads whole texts of any length, in slices.

Cases: a null text or one without a letter is ``und`` with score 0 and rejected; equal cosines go to
the alphabetically first language; repeated rows are predicted each; an empty table gives an empty
result; without any labelled document every text is ``und``; other columns are kept by ``identify``
unless they have the name of a result column, which then is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireworks.llm.common import held_out, make_room, slices, table, text_bytes

DIMENSIONS, CENTROIDS, ROUNDS = 4096, 4, 12
PER_LANGUAGE, SAMPLE_ROWS = 400, 400 * 64
LOW, SHARE = 0.02, 0.25
#: Texts counted together at most: each takes a row of ``DIMENSIONS`` however short it is.
ROWS_TOGETHER = 128
UNKNOWN = "und"
FOLDS = 5

#: Byte classes: letters and bytes of longer characters stand for themselves, all else is a blank.
_CLASS = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


@dataclass(frozen=True)
class Centroids:
    names: tuple[str, ...]
    idf: np.ndarray
    vectors: np.ndarray
    owner: np.ndarray
    min_score: np.ndarray


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts, one row per text (bytes of lower-cased texts)."""
    rows = len(offsets) - 1
    size = offsets[-1] - offsets[0]
    out = np.zeros(rows * DIMENSIONS, np.float32)
    if not size:
        return out.reshape(rows, DIMENSIONS)
    # A blank before and after each text, so no n-gram crosses texts.
    lengths = np.diff(offsets)
    start = offsets[:-1] - offsets[0] + np.arange(rows) * 2 + 1
    row = np.repeat(np.arange(rows), lengths)
    classes = np.full(size + 2 * rows, 32, np.uint32)
    place = np.arange(size) + 2 * row + 1
    classes[place] = _CLASS[data[offsets[0] : offsets[-1]]]
    owner = np.zeros(len(classes), np.int64)
    owner[start - 1] = 1
    owner = (np.cumsum(owner) - 1) * DIMENSIONS
    a, b, c = classes[:-2], classes[1:-1], classes[2:]
    pair = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)) >> np.uint32(20)
    triple = (a * np.uint32(0x9E3779B1) + b * np.uint32(0xC2B2AE35) + c * np.uint32(0x27D4EB2F)) >> np.uint32(20)
    letters = (b != 32)
    inside = owner[:-2] == owner[2:]
    for grams, kept in ((pair, inside & (letters | (a != 32))), (triple, inside & letters)):
        out += np.bincount(owner[:-2][kept] + grams[kept], minlength=len(out)).astype(np.float32)
    return out.reshape(rows, DIMENSIONS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(x) * idf)


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from vectors that are far from those chosen before."""
    centres = [x[0]]
    while len(centres) < min(k, len(x)):
        centres.append(x[np.argmin((x @ np.array(centres).T).max(axis=1))])
    c = _unit(np.array(centres))
    for _ in range(ROUNDS):
        nearest = (x @ c.T).argmax(axis=1)
        c = _unit(np.array([x[nearest == i].mean(axis=0) if (nearest == i).any() else c[i] for i in range(len(c))]))
    return c


def fit(docs: DataFrame, k: int = CENTROIDS, per_language: int = PER_LANGUAGE) -> Centroids:
    """Centroids from ``docs`` (doc_id, text, lang); rows without language or letters are not used."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = labelled.select("doc_id", "lang").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
    kept = min(per_language, max(k, SAMPLE_ROWS // max(1, ids.select("lang").distinct().count())))
    sample = labelled.join(ids.where(F.col("rank") <= kept).select("doc_id", "lang"), ["doc_id", "lang"], "left_semi").select("lang", "text")
    rows = sorted((r["lang"], bytes(r["packed"])) for r in sample.mapInArrow(_packed_counts, "lang string, packed binary").collect())
    if not rows:
        return Centroids((), np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.int64), np.zeros(0))
    x = np.concatenate([np.frombuffer(zstandard.decompress(packed), np.float32)[None] for _, packed in rows])
    names = sorted({lang for lang, _ in rows})
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x, langs = _weigh(x, idf), np.array([lang for lang, _ in rows])
    groups = [_cluster(x[langs == name], k) for name in names]
    owner = np.repeat(np.arange(len(names)), [len(g) for g in groups])
    vectors = np.concatenate(groups).astype(np.float32)
    model = Centroids(tuple(names), idf, vectors, owner, np.zeros(len(names)))
    return replace(model, min_score=SHARE * _low_cosines(labelled, model))


def _long_counts(data: np.ndarray, offsets: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Counts of one text of any length, piece by piece with two bytes of overlap."""
    lo, hi = offsets
    total = np.zeros((1, DIMENSIONS), np.float32)
    for start in range(lo, hi, step):
        total += counts(data, np.array([start, min(hi, start + step)]))
    return total


def _counted(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Counts of consecutive rows [i, j) of texts."""
    data, offsets = text_bytes(pc.utf8_lower(text))
    for first, last in slices(offsets, 1 << 18):
        for i in range(first, last, ROWS_TOGETHER):
            j = min(last, i + ROWS_TOGETHER)
            part = offsets[i : j + 1]
            yield i, j, _long_counts(data, part) if j == i + 1 else counts(data, part)


def _packed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make_room("language")
    for batch in batches:
        packed = [zstandard.compress(row.tobytes(), 1) for _, _, x in _counted(batch.column("text")) for row in x]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(packed, pa.binary())], ["lang", "packed"])


def _low_cosines(labelled: DataFrame, model: Centroids) -> np.ndarray:
    """For each language, the cosine with its own centroids that all but LOW of its labelled documents reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("language")
        number = {name: i for i, name in enumerate(model.names)}
        for batch in batches:
            lang = np.array([number.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
            own = np.zeros(len(lang))
            for i, j, x in _counted(batch.column("text")):
                cosines = _weigh(x, model.idf) @ model.vectors.T
                own[i:j] = np.where(model.owner[None, :] == lang[i:j, None], cosines, 0).max(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(own)], ["lang", "own"])

    reached = labelled.select("lang", "text").mapInArrow(run, "lang bigint, own double").where("lang >= 0")
    low = np.zeros(len(model.names))
    for row in reached.groupBy("lang").agg(F.percentile_approx("own", LOW).alias("low")).collect():
        low[row["lang"]] = row["low"]
    return low


def _identify(model: Centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("language")
        names, needed = np.array([*model.names, UNKNOWN], object), np.append(model.min_score, 0.0)
        for batch in batches:
            text = pc.fill_null(batch.column(batch.schema.get_field_index("text")), "")
            known = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False) & bool(model.names)
            best, score = np.full(len(text), len(model.names)), np.zeros(len(text))
            for i, j, x in _counted(text):
                if len(model.names):
                    cosines = _weigh(x, model.idf) @ model.vectors.T
                    best[i:j] = model.owner[cosines.argmax(axis=1)]
                    score[i:j] = cosines.max(axis=1)
            best[~known], score[~known] = len(model.names), 0.0
            score = np.clip(score, 0.0, 1.0)
            out = {"lang_pred": pa.array(names[best], pa.string()), "score": pa.array(score), "rejected": pa.array(~known | (score < needed[best]))}
            for name, column in zip(batch.schema.names, batch.columns):
                out.setdefault(name, column)
            yield pa.RecordBatch.from_pydict(out)

    return run


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """``docs`` with lang_pred, score and rejected (the centroid is too far, or there is no letter)."""
    docs = docs.drop("lang_pred", "score", "rejected")
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.mapInArrow(_identify(model), T.StructType(schema.fields + docs.schema.fields))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    away = held_out(F.col("doc_id"), FOLDS, 0)
    model = fit(docs.where(~away).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", away.alias("held_out"), "lang_pred", "score", "rejected")

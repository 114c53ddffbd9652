"""Quality by a factorisation machine.

A text's features are its words, hashed, with damped and scaled counts, and a few structure statistics
(length, word length, shares of letters, digits, capitals, punctuation, blanks and line breaks, repeated
words and lines). Score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The sum over pairs is
computed in linear time as half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

The fit takes a bounded number of labelled documents (``MAX_ROWS``, smallest hash of the id, whole texts
of up to ``MAX_BYTES``), as feature vectors made by the executors, and trains by AdaGrad in a fixed
order, so it is repeatable. Afterwards the scores are calibrated (Platt) on a fifth of these rows that the
training leaves out, so 0.7 means what it says. Scoring reads whole texts.

Cases: a null text counts as empty; an empty text has only the constant features and is scored all the
same; repeated rows are scored each; an empty table gives an empty result; without labels, or with one
class, every score is the share of label 1 (0.5 without labels); a null label is not used; of several
labels for one document the largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import held_out, mix, slices, table, text_bytes

BUCKETS, FACTORS, EPOCHS, BATCH = 8192, 8, 8, 64
MAX_ROWS, MAX_BYTES, THRESHOLD, FOLDS, AWAY = 6000, 50_000, 0.7, 4, 2
STATISTICS = 12
WIDTH = BUCKETS + STATISTICS
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_KIND = np.zeros(256, np.int8)  # 1 letter, 2 capital, 3 digit, 4 punctuation, 5 blank
_KIND[128:] = 1
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[np.isin(np.arange(256), list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))] = 4
_KIND[_SPACE] = 5


@dataclass(frozen=True)
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    slope: float
    shift: float


def _hashes(data: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the runs of bytes between those where ``split`` holds."""
    inside = ~split
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    begins = np.zeros(len(data), np.int64)
    begins[start] = start
    place = (np.arange(len(data)) - np.maximum.accumulate(begins)).astype(np.uint64)
    value = np.where(inside, mix(mix((place + np.uint64(1)) * _BASE) + data), np.uint64(0))
    return start, mix(np.add.reduceat(value, start) + (end - start).astype(np.uint64))


def _repeated(owner: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """Per text, the share of its pieces that occurred in it before."""
    order = np.lexsort((hashes, owner))
    again = (np.diff(owner[order]) == 0) & (np.diff(hashes[order].astype(np.int64)) == 0)
    total = np.bincount(owner, minlength=rows)
    return np.bincount(owner[order][1:][again], minlength=rows) / np.maximum(total, 1)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, column, value) of the texts, sorted by row."""
    rows, base = len(offsets) - 1, offsets[0]
    # A blank after every text keeps words and lines of different texts apart.
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(rows), lengths + 1)
    text = np.full(len(owner), 32, np.uint8)
    text[np.arange(offsets[-1] - base) + np.repeat(np.arange(rows), lengths)] = data[base : offsets[-1]]
    final = np.cumsum(lengths + 1) - 1
    word_start, words = _hashes(_LOWER[text], _SPACE[text])
    line_break = text == 10
    line_break[final] = True
    line_start, lines = _hashes(text, line_break)
    word_row, line_row = owner[word_start], owner[line_start]
    column = (words % np.uint64(BUCKETS)).astype(np.int64)
    key, count = np.unique(word_row * BUCKETS + column, return_counts=True)
    row, column, value = key // BUCKETS, key % BUCKETS, np.log1p(count)
    norm = np.sqrt(np.bincount(row, value**2, minlength=rows))
    value = value / np.maximum(norm[row], 1e-9)
    kinds = np.bincount(owner * 6 + _KIND[text], minlength=rows * 6).reshape(rows, 6)
    kinds[:, 5] -= 1
    size = np.maximum(lengths, 1)[:, None]
    n_words, n_lines = np.bincount(word_row, minlength=rows), np.bincount(line_row, minlength=rows)
    statistics = np.column_stack(
        [
            np.log1p(lengths) / 12,
            np.log1p(n_words) / 10,
            np.log1p(n_lines) / 8,
            np.minimum(lengths / np.maximum(n_words, 1) / 10, 3),
            kinds[:, 1:6] / size,
            _repeated(word_row, words, rows),
            _repeated(line_row, lines, rows),
            np.ones(rows),
        ]
    )
    row = np.concatenate([row, np.repeat(np.arange(rows), STATISTICS)])
    column = np.concatenate([column, np.tile(np.arange(BUCKETS, WIDTH), rows)])
    value = np.concatenate([value, statistics.ravel()])
    order = np.argsort(row, kind="stable")
    return row[order], column[order], value[order]


def raw_scores(row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, model: Model) -> np.ndarray:
    """The machine's value per row, in time linear in the number of non-zero features."""
    out = model.bias + np.bincount(row, value * model.linear[column], minlength=rows)
    for f in range(model.factors.shape[1]):
        term = value * model.factors[column, f]
        out += 0.5 * (np.bincount(row, term, minlength=rows) ** 2 - np.bincount(row, term**2, minlength=rows))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Model:
    """Factorisation machine on rows (columns, values) with labels 0 and 1."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        odds = np.log(np.clip(share, 1e-9, 1 - 1e-9) / np.clip(1 - share, 1e-9, 1))
        return Model(0.0, np.zeros(WIDTH), np.zeros((WIDTH, FACTORS)), 0.0, float(odds))
    rng = np.random.default_rng(7)
    apart = np.arange(len(y)) % 5 == 4
    if len(y) < 50 or y[apart].min() == y[apart].max():
        apart = np.zeros(len(y), bool)
    w0, w, v = 0.0, np.zeros(WIDTH, np.float32), rng.normal(0, 0.05, (WIDTH, FACTORS)).astype(np.float32)
    g0, gw, gv = 1e-6, np.full(WIDTH, 1e-6, np.float32), np.full((WIDTH, FACTORS), 1e-6, np.float32)
    chosen = np.flatnonzero(~apart)
    for _ in range(EPOCHS):
        rng.shuffle(chosen)
        for start in range(0, len(chosen), BATCH):
            part = chosen[start : start + BATCH]
            dense = np.zeros((len(part), WIDTH), np.float32)
            for i, k in enumerate(part):
                dense[i, x[k][0]] = x[k][1]
            sums = dense @ v
            raw = w0 + dense @ w + 0.5 * (sums**2 - dense**2 @ v**2).sum(axis=1)
            slope = ((_sigmoid(raw) - y[part]) / len(part)).astype(np.float32)
            weighed = dense * slope[:, None]
            d0, dw = float(slope.sum()), weighed.sum(axis=0) + 1e-6 * w
            dv = weighed.T @ sums - v * (weighed * dense).sum(axis=0)[:, None] + 1e-5 * v
            g0, gw, gv = g0 + d0**2, gw + dw**2, gv + dv**2
            w0, w, v = w0 - 0.1 * d0 / g0**0.5, w - 0.1 * dw / np.sqrt(gw), v - 0.05 * dv / np.sqrt(gv)
    model = Model(w0, w.astype(float), v.astype(float), 1.0, 0.0)
    judged = np.flatnonzero(apart) if apart.any() else np.arange(len(y))
    row = np.repeat(np.arange(len(judged)), [len(x[k][0]) for k in judged])
    raw = raw_scores(row, np.concatenate([x[k][0] for k in judged]), np.concatenate([x[k][1] for k in judged]), len(judged), model)
    return _calibrate(model, raw, y[judged])


def _calibrate(model: Model, raw: np.ndarray, y: np.ndarray) -> Model:
    """Platt's slope and shift by Newton steps, with his smoothed targets."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    x = np.column_stack([raw, np.ones(len(raw))])
    for _ in range(30):
        p = _sigmoid(a * raw + b)
        curve = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (p - target) + 1e-3 * np.array([a - 1, b]))
        a, b = a - step[0], b - step[1]
    return Model(model.bias, model.linear, model.factors, float(max(a, 1e-3)), float(b))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for i, j in slices(offsets):
            row, column, value = features(data, offsets[i : j + 1])
            cut = np.searchsorted(row, np.arange(1, j - i))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label").slice(i, j - i),
                    pa.array([c.astype(np.int32).tobytes() for c in np.split(column, cut)], pa.binary()),
                    pa.array([c.astype(np.float32).tobytes() for c in np.split(value, cut)], pa.binary()),
                ],
                ["label", "columns", "cells"],
            )


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1)."""
    labels = labels.where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    fitting = docs.where(F.octet_length(F.coalesce("text", F.lit(""))) <= max_bytes).select("doc_id").distinct()
    picked = labels.join(fitting, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.join(picked, "doc_id").dropDuplicates(["doc_id"]).select("label", "text")
    rows = sample.mapInArrow(_sparse, "label int, columns binary, cells binary").toPandas()
    rows = rows.sort_values(["columns", "cells", "label"])
    x = [(np.frombuffer(c, np.int32), np.frombuffer(v, np.float32)) for c, v in zip(rows["columns"], rows["cells"])]
    return train(x, rows["label"].to_numpy(np.float64))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            out = np.zeros(len(offsets) - 1)
            for i, j in slices(offsets):
                row, column, value = features(data, offsets[i : j + 1])
                out[i:j] = raw_scores(row, column, value, j - i, model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_sigmoid(model.slope * out + model.shift))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for ``docs`` (doc_id, text): the higher, the likelier label 1."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_score(model), "doc_id bigint, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def away(c: Column) -> Column:
        return held_out(c, FOLDS, AWAY)

    labels = table(spark, sf_dir, "labels").where(~away(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", away(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

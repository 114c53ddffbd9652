"""Document fingerprints from improbable features.

Every window of ``WINDOW`` bytes has an entropy, counted in ``BINS`` classes. How rare a class is among
all windows of the corpus ranks its windows; a window that is the rarest of at least ``POPULAR`` of the
``SPAN`` successive windows around it is a feature. A text without such a window (a short one, or one whose
windows are all of one class) has the rarest window of each ``SPAN`` instead, so every text that is not
empty has a feature. Features go by hash into chained Bloom filters (``BITS``
bits, ``HASHES`` each, ``FEATURES`` per filter, then the next filter). Two fingerprints are compared by the
overlap of bits beyond what chance gives, over the most that there could be: each filter of the shorter
chain against its best partner, averaged.

Entropies are whole numbers that telescope exactly, so equal texts have equal fingerprints wherever
they stand. The rarity table is counted over all texts of the corpus and has ``BINS`` rows.

Each text is also compared with an edited copy of itself, whose last quarter comes from the next document,
and with the next document. Neighbours are found without a global window: documents are dealt to ranges of
doc_id, each sorted, and the first document of a range also goes to the range before it (that of the first
range to the last).

Cases: null text counts as empty, an empty text has an empty fingerprint, and two empty ones are alike
(1), an empty and another one are not (0); a text shorter than a window is one feature; a null doc_id
comes before all others; of equal doc_ids the order is by text; a single document is its own next one; an
empty table gives an empty result; other columns are ignored. A text of n bytes takes about 60 n bytes of
memory while it is worked on, and texts are taken one MB at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import mix, slices, table, text_bytes

WINDOW, BINS, SPAN, POPULAR = 64, 1000, 64, 16
BITS, HASHES, FEATURES = 2048, 5, 160
RANGE_BYTES, MAX_RANGES = 4 << 20, 10_000
_UNIT = 1 << 20
_LOWEST = -(1 << 63)
_G = np.array([0] + [round(c * math.log2(c) * _UNIT) for c in range(1, WINDOW + 1)], np.int64)
_STEP = np.diff(_G)
_MOST = int(_G[WINDOW])
_WEIGHTS = mix(np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """The class of the window that ends at each byte, from the (WINDOW - 1)th on."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lo in range(0, n, 1 << 16):  # parts that stay in the cache
        part = data[max(0, lo - WINDOW + 1) : lo + (1 << 16)]
        lead = lo - max(0, lo - WINDOW + 1)
        for k in range(1, WINDOW):
            same = part[k:] == part[:-k] if k < len(part) else np.zeros(0, bool)
            first = max(0, lead - k)  # pairs whose later byte is in this part
            same = same[first:]
            at = lo - lead + first
            before[at + k : at + k + len(same)] += same
            after[at : at + len(same)] += same
    change = _STEP[before]
    change[WINDOW:] -= _STEP[after[:-WINDOW]]
    total = np.cumsum(change)[WINDOW - 1 :]
    return np.minimum((_MOST - total) * BINS // _MOST, BINS - 1)


def _windows_inside(offsets: np.ndarray) -> np.ndarray:
    """For each byte, whether the window that ends there lies in one text."""
    n = offsets[-1] - offsets[0]
    start = np.repeat(offsets[:-1] - offsets[0], np.diff(offsets))
    return np.arange(n) - start >= WINDOW - 1


def _count_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BINS, np.int64)
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for i, j in slices(offsets):
            part = data[offsets[i] : offsets[j]]
            if len(part) >= WINDOW:
                inside = _windows_inside(offsets[i : j + 1])[WINDOW - 1 :]
                total += np.bincount(entropy_classes(part)[inside], minlength=BINS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(total)], ["class", "n"])


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy class by how many windows of all texts have it; the rarest is 0."""
    counted = docs.select("text").mapInArrow(_count_classes, "class bigint, n bigint").groupBy("class").agg(F.sum("n").alias("n"))
    counts = np.zeros(BINS, np.int64)
    for row in counted.collect():
        counts[row["class"]] = row["n"]
    rank = np.empty(BINS, np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(BINS)
    return rank


def _sliding_min(x: np.ndarray) -> np.ndarray:
    width = 1
    while width < SPAN:
        x = np.minimum(x[:-width], x[width:]) if len(x) > width else x[:0]
        width *= 2
    return x


def feature_hashes(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray, fill: bool = False) -> list[np.ndarray]:
    """The distinct feature hashes of each text, in order of place.

    With ``fill``, a text without a popular window has the rarest window of each SPAN.
    """
    base, rows = offsets[0], len(offsets) - 1
    data, starts = data[base : offsets[-1]], offsets - base
    popular = np.zeros(len(data), np.int64)
    if len(data) >= WINDOW:
        key = np.full(len(data), np.iinfo(np.int64).max)
        key[WINDOW - 1 :] = (rank[entropy_classes(data)] << 40) | np.arange(WINDOW - 1, len(data))
        key[~_windows_inside(offsets)] = np.iinfo(np.int64).max
        best = _sliding_min(key)
        owner = np.repeat(np.arange(rows), np.diff(offsets))
        whole = _windows_inside(offsets)[: len(best)] & (owner[: len(best)] == owner[SPAN - 1 :][: len(best)])
        popular = np.bincount(best[whole] & ((1 << 40) - 1), minlength=len(data))
    out = []
    windows = np.lib.stride_tricks.sliding_window_view(data, WINDOW) if len(data) >= WINDOW else None
    for s, e in zip(starts[:-1], starts[1:]):
        size = e - s
        if size == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        if size < WINDOW:
            digest = hashlib.blake2b(data[s:e].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(digest, np.uint64))
            continue
        if size < WINDOW + SPAN - 1:
            chosen = np.array([(key[s + WINDOW - 1 : e].min()) & ((1 << 40) - 1)])
        else:
            chosen = np.flatnonzero(popular[s:e] >= POPULAR) + s
            if fill and not len(chosen):
                chosen = np.minimum.reduceat(key[s + WINDOW - 1 : e], np.arange(0, size - WINDOW + 1, SPAN)) & ((1 << 40) - 1)
        picked = windows[chosen - WINDOW + 1].astype(np.uint64)
        hashes = mix((mix(picked + np.uint64(1)) * _WEIGHTS).sum(axis=1, dtype=np.uint64))
        _, first = np.unique(hashes, return_index=True)
        out.append(hashes[np.sort(first)])
    return out


def bloom_chain(hashes: np.ndarray) -> np.ndarray:
    """Packed filters, one row per FEATURES hashes."""
    count = -(-len(hashes) // FEATURES)
    bits = np.zeros((count, BITS), np.uint8)
    row = np.arange(len(hashes)) // FEATURES
    for k in range(HASHES):
        bits[row, ((hashes >> np.uint64(11 * k)) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Overlap beyond chance of two chains of packed filters, from 0 to 1."""
    if not len(one) or not len(other):
        return float(len(one) == len(other))
    if len(one) > len(other):
        one, other = other, one
    a, b = np.bitwise_count(one).sum(axis=1, dtype=np.int64), np.bitwise_count(other).sum(axis=1, dtype=np.int64)
    total = 0.0
    for row, size in zip(one, a):
        both = np.bitwise_count(row & other).sum(axis=1, dtype=np.int64)
        chance, most = size * b / BITS, np.minimum(size, b)
        total += float(np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return total / len(one)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``following``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rank: np.ndarray):
    """From rows in order (a range's own and, last, the first of the next range) to their comparison."""

    def chains(texts: list[str]) -> list[np.ndarray]:
        data, offsets = text_bytes(pa.array(texts, pa.large_string()))
        return [bloom_chain(h) for i, j in slices(offsets) for h in feature_hashes(data, offsets[i : j + 1], rank, fill=True)]

    def finished(group: list[tuple]) -> pa.RecordBatch:
        """The rows of ``group`` but the last, which is the next document only."""
        texts = [text for _, text, _ in group]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        own, other = chains(texts), chains(changed)
        rows = [i for i in range(len(group) - 1) if not group[i][2]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([group[i][0] for i in rows], pa.int64()),
                pa.array([len(texts[i]) for i in rows], pa.int64()),
                pa.array([hashlib.sha256(changed[i].encode()).hexdigest() for i in rows], pa.string()),
                pa.array([own[i].tobytes().hex() for i in rows], pa.string()),
                pa.array([other[i].tobytes().hex() for i in rows], pa.string()),
                pa.array([likeness(own[i], other[i]) for i in rows], pa.float64()),
                pa.array([likeness(own[i], own[i + 1]) for i in rows], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        size, piece = 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("piece", "doc_id", "text", "halo")]
            for number, doc_id, text, halo in zip(*columns):
                if number != piece:
                    if len(group) > 1:
                        yield finished(group)
                    group, size, piece = [], 0, number
                group.append((doc_id, text or "", halo))
                size += len(text or "")
                if size > 2_000_000 and len(group) > 1:
                    yield finished(group)
                    group, size = group[-1:], len(text or "")
        if len(group) > 1:
            yield finished(group)

    return run


def _deal(bounds: np.ndarray, firsts: dict[int, list[int]]):
    """Adds ``piece`` (the range of the doc_id) and repeats the first document of a range in the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("place").to_numpy()
            piece = np.searchsorted(bounds, key, side="right")
            extra = [(i, p) for i in np.flatnonzero(np.isin(key, list(firsts))) for p in firsts[int(key[i])]]
            take = pa.array([*range(len(key)), *(i for i, _ in extra)], pa.int64())
            rows = batch.take(take)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([piece, [p for _, p in extra]]).astype(np.int64)),
                    pa.array([False] * len(key) + [True] * len(extra), pa.bool_()),
                    *rows.columns,
                ],
                ["piece", "halo", *rows.schema.names],
            )

    return run


def with_neighbours(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as (piece, halo, place, doc_id, text), sorted within each piece."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LOWEST)).alias("place"), F.col("doc_id").cast("bigint"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = min(MAX_RANGES, max(1, -(-size // RANGE_BYTES)))
    bounds = []
    if ranges > 1:
        bounds = docs.agg(F.percentile_approx("place", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []
    bounds = np.unique(np.array(bounds, np.int64))
    pieces = _first_places(docs, bounds)
    order = sorted(pieces)
    firsts: dict[int, list[int]] = {}
    for before, piece in zip(order, order[1:] + order[:1]):
        firsts.setdefault(pieces[piece], []).append(before)
    dealt = docs.mapInArrow(_deal(bounds, firsts), "piece bigint, halo boolean, place bigint, doc_id bigint, text string")
    return dealt.repartition("piece").sortWithinPartitions("piece", "halo", "place", "text")


def _first_places(docs: DataFrame, bounds: np.ndarray) -> dict[int, int]:
    """The smallest place in each range that has documents: one row per range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        for batch in batches:
            key = batch.column("place").to_numpy()
            for piece, place in zip(np.searchsorted(bounds, key, side="right").tolist(), key.tolist()):
                least[piece] = min(place, least.get(piece, place))
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int64()), pa.array(list(least.values()), pa.int64())], ["piece", "place"])

    found = docs.select("place").mapInArrow(run, "piece bigint, place bigint").groupBy("piece").agg(F.min("place").alias("place"))
    return {r["piece"]: r["place"] for r in found.collect()}


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for ``docs`` (doc_id, text)."""
    rank = rarity(docs)
    rows = with_neighbours(docs).select("piece", "halo", "doc_id", "text")
    return rows.mapInArrow(_compare(rank), _OUT)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))

"""Exact top-k inner products, term at a time.

Vectors become whole numbers and are packed into blocks of rows. A block of queries meets every block
of candidates; there the queries are rows of terms (their non-zero components), and the terms scatter
their weighted postings (the candidates with a non-zero component there) into dense arrays of scores, for
256 queries and 2,048 candidates at once. Terms that many candidates hold are added up together, as one
matrix product in the narrowest numbers that hold every sum exactly; terms that few hold come one by one.
Only what beats the k-th best so far is looked at again, and the blocks' short lists are merged.
Rows are dealt to blocks of bounded size by a hash of id and vector, so a hot label, source or
repeated row plays no part; every pair of blocks is one equality-joined row. Blocks hold components in
as few bytes as their values need.

Cases: vectors that are null, or hold null or non-finite components, take no part; missing components
of a shorter vector count as 0; equal scores go to the smaller vec_id; of rows with equal vec_id each
is a candidate of its own (a query's own row is every row of its id) and a repeated query id is asked
once, with its smallest vector; an empty table gives an empty result. Scores are 64-bit whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireworks.llm.common import table

K, EVERY, SCALE = 5, 50, 256
#: Rows and components that a block may hold, and rows below which a table is not dealt to more blocks for the sake of more tasks.
BLOCK_ROWS, BLOCK_VALUES, LEAST_ROWS = 65_536, 1 << 22, 4096
#: Queries and candidates whose scores are one dense array; a term is scattered alone if fewer than one in so many candidates hold it.
TILE_QUERIES, TILE_ROWS, SPARSE = 256, 2048, 8
_PACKED = "block int, ids binary, vectors binary, width int"
_KINDS = (np.int8, np.int16, np.int32, np.int64)


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components times ``scale``, rounded down, of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good).select(
        F.col("vec_id").cast("bigint"), F.transform(x, lambda c: F.floor(c * scale).cast("bigint")).alias("v")
    )


def _pack(rows: pa.Table) -> pa.Table:
    """A block in one row, by id: ids, and components in as few bytes as they need."""
    rows = rows.sort_by("vec_id").combine_chunks()
    v = rows["v"].combine_chunks()
    sizes = v.value_lengths().to_numpy()
    width = int(sizes.max())
    dense = np.zeros((len(sizes), width), np.int64)
    dense[np.arange(width) < sizes[:, None]] = v.flatten().to_numpy()
    low, high = (int(dense.min()), int(dense.max())) if dense.size else (0, 0)
    kind = next(k for k in _KINDS if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    columns = {"block": rows["block"][:1], "ids": [rows["vec_id"].to_numpy().tobytes()], "vectors": [dense.astype(kind).tobytes()], "width": pa.array([width], pa.int32())}
    return pa.table({k: c if isinstance(c, pa.Array | pa.ChunkedArray) else pa.array(c, pa.binary()) for k, c in columns.items()})


def _blocks(vectors: DataFrame, tasks: int = 1) -> tuple[DataFrame, int]:
    """The vectors in packed blocks, one row each, and the number of blocks: more than needed if that makes up to ``tasks``."""
    rows, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    most = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(1, width or 1)))
    count = max(1, -(-rows // most), min(tasks, -(-rows // LEAST_ROWS)))
    dealt = vectors.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int").alias("block"), "vec_id", "v")
    return dealt.groupBy("block").applyInArrow(_pack, _PACKED), count


def _unpack(ids: bytes, vectors: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    size = len(vectors) // max(1, len(ids) * width)
    kind = next((k for k in _KINDS if np.dtype(k).itemsize == size), np.int64)
    return ids, np.frombuffer(vectors, kind).reshape(len(ids), width)


def exact_kind(queries: np.ndarray, block: np.ndarray) -> type:
    """The narrowest numbers in which every sum of products is exact: no part of a sum is beyond the product of the lengths."""
    longest = [math.sqrt(max((np.einsum("ij,ij->i", x, x).max() for x in (v[i : i + TILE_ROWS].astype(np.float64) for i in range(0, len(v), TILE_ROWS))), default=0.0)) for v in (queries, block)]
    bound = max(1.0, longest[0]) * max(1.0, longest[1]) * (1 + 1e-6)
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def _best(asked: np.ndarray, found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The first ``k`` of what is found for each query, as (query, id, score) by query, score and id; and their places."""
    query, ids, scores = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    kept = place < k
    return query[kept], ids[kept], scores[kept], place[kept]


def best_in_block(asked: np.ndarray, queries: np.ndarray, ids: np.ndarray, block: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the best ``k`` candidates of a block for each query, by score and then id.

    ``ids`` are in order, so a candidate that only equals the ``k``-th best so far comes too late.
    """
    width = min(queries.shape[1], block.shape[1])
    queries, block = queries[:, :width], block[:, :width]
    kind = exact_kind(queries, block)
    lowest = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    held = np.count_nonzero(block, axis=0)
    dense, sparse = np.flatnonzero(held * SPARSE >= len(ids)), np.flatnonzero((held > 0) & (held * SPARSE < len(ids)))
    postings = {t: (rows := np.flatnonzero(block[:, t]), block[rows, t].astype(kind)) for t in sparse}
    weights = np.ascontiguousarray(block[:, dense], kind)
    out = []
    for first in range(0, len(asked), TILE_QUERIES):
        own, terms = asked[first : first + TILE_QUERIES], queries[first : first + TILE_QUERIES].astype(kind)
        from_dense = np.ascontiguousarray(terms[:, dense].T)
        left, right = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        own_query = np.repeat(np.arange(len(own)), right - left)
        own_row = np.arange(len(own_query)) + np.repeat(left - np.concatenate(([0], np.cumsum(right - left)[:-1])), right - left)
        bar = np.full(len(own), lowest, kind)
        found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, kind),)]
        pending, room, beats = 0, np.empty((TILE_ROWS, len(own)), kind), np.empty((TILE_ROWS, len(own)), bool)
        for start in range(0, len(ids), TILE_ROWS):
            stop = min(start + TILE_ROWS, len(ids))
            scores = np.matmul(weights[start:stop], from_dense, out=room[: stop - start])
            for t, (rows, weight) in postings.items():
                a, b = np.searchsorted(rows, (start, stop))
                wanted = np.flatnonzero(terms[:, t])
                if a < b and len(wanted):
                    scores[np.ix_(rows[a:b] - start, wanted)] += np.multiply.outer(weight[a:b], terms[wanted, t])
            here = (own_row >= start) & (own_row < stop)
            scores[own_row[here] - start, own_query[here]] = lowest
            if start == 0 and stop > k:
                hits = np.flatnonzero(scores >= np.partition(scores, stop - k, axis=0)[stop - k])
            else:
                better = np.greater(scores, bar, out=beats[: stop - start])
                better[:, bar == lowest] = True
                hits = np.flatnonzero(better)
            row, query = np.divmod(hits, len(own))
            other = ids[start + row] != own[query]
            row, query = row[other], query[other]
            found.append((query, ids[start + row], scores[row, query]))
            pending += len(row)
            if start == 0 or pending > 2 * k * len(own):
                query, of, score, place = _best(own, found, k)
                found, pending = [(query, of, score)], 0
                bar[query[place == k - 1]] = score[place == k - 1]
        query, of, score, _ = _best(own, found, k)
        out.append((own[query], of, score.astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _score(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                found = best_in_block(*_unpack(row["q_ids"], row["q_vectors"], row["q_width"]), *_unpack(row["ids"], row["vectors"], row["width"]), k)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["query_id", "vec_id", "score"])

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best candidates for each query; both are (vec_id, v)."""
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    asked, n_asked = _blocks(queries)
    blocks, n_blocks = _blocks(candidates, candidates.sparkSession.sparkContext.defaultParallelism)

    def numbered(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    pair, parts = ["block", "q_block"], 2 * n_asked * n_blocks  # few pairs a task, as Python is sent a task's pairs together
    blocks = blocks.withColumn("q_block", numbered(n_asked)).repartition(parts, *pair)
    asked = asked.toDF("q_block", "q_ids", "q_vectors", "q_width").withColumn("block", numbered(n_blocks)).repartition(parts, *pair)
    found = blocks.join(asked, pair).mapInArrow(_score(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


SQL = """
WITH good AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM good q JOIN good c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

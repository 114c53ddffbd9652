"""Scores of a summary against a reference text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireworks.functions import text as tx
from quireworks.functions import vectors as vec
from quireworks.functions.skew import salted_join


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def unigram_overlap(pairs: DataFrame, key: str, candidate: str, reference: str) -> DataFrame:
    """(key, n_overlap, n_candidate, n_reference, precision, recall, f1) by shared words.

    Only pairs with both texts count. The words of both sides go through one aggregate
    with a counter per side, so there is no join, and the texts are spread by key before
    they are taken apart, so there is no shuffle of words.
    """
    def side(column: str, left: int) -> Column:
        return F.transform(
            tx.tokens(F.col(column)), lambda t: F.struct(t.alias("term"), F.lit(left).alias("c"), F.lit(1 - left).alias("r"))
        )

    both = pairs.where((F.coalesce(candidate, F.lit("")) != "") & (F.coalesce(reference, F.lit("")) != ""))
    counts = (
        both.select(key, candidate, reference)
        .repartition(key)
        .select(key, F.explode_outer(F.concat(side(candidate, 1), side(reference, 0))).alias("t"))
        .groupBy(key, "t.term")
        .agg(F.coalesce(F.sum("t.c"), F.lit(0)).alias("c"), F.coalesce(F.sum("t.r"), F.lit(0)).alias("r"))
    )
    totals = counts.groupBy(key).agg(
        F.sum(F.least("c", "r")).alias("n_overlap"), F.sum("c").alias("n_candidate"), F.sum("r").alias("n_reference")
    )
    return (
        totals.withColumn("precision", F.coalesce(F.try_divide("n_overlap", "n_candidate"), F.lit(0.0)))
        .withColumn("recall", F.coalesce(F.try_divide("n_overlap", "n_reference"), F.lit(0.0)))
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    )


def greedy_match(pairs: DataFrame, candidate: str, reference: str) -> DataFrame:
    """Add precision, recall and f1 from token vectors (arrays of vectors on both sides).

    Precision is the mean, over candidate vectors, of the best cosine to any reference
    vector; recall is the reverse. The vectors of a pair stay in its row.
    """
    scaled = pairs.withColumn("_c", F.transform(candidate, vec.unit)).withColumn("_r", F.transform(reference, vec.unit))

    def mean_best(a: str, b: str) -> Column:
        best = F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: vec.dot(x, y))))
        total = F.aggregate(best, F.lit(0.0), lambda s, x: s + x)
        return F.try_divide(total, F.size(a))

    return (
        scaled.withColumn("precision", mean_best("_c", "_r"))
        .withColumn("recall", mean_best("_r", "_c"))
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))
        .drop("_c", "_r")
    )


def _best_cosines(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """For each vector of two blocks its best cosine to a vector of the other block."""

    def scaled(vectors: pd.Series) -> np.ndarray:
        x = np.array(vectors.tolist(), np.float64)
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, length, out=np.zeros_like(x), where=length > 0)

    cosines = scaled(left["vector"]) @ scaled(right["vector"]).T
    rows = [(0, left["pos"], cosines.max(axis=1)), (1, right["pos"], cosines.max(axis=0))]
    return pd.concat([pd.DataFrame({"pair": key[0], "side": side, "pos": pos.to_numpy(), "best": best}) for side, pos, best in rows])


def greedy_match_tiled(vectors: DataFrame, block: int = 512) -> DataFrame:
    """(pair, precision, recall, f1) from long rows (pair, side, pos, vector), side 0 the candidate, 1 the reference.

    As :func:`greedy_match` for texts of any length: the vectors of a pair are never in one row. Blocks of
    ``block`` vectors meet all blocks of the other side, each two as one matrix product, and only the best
    cosine of each vector leaves a product. A pair without vectors on one side is left out.
    """
    rows = vectors.select(F.col("pair").cast("bigint"), F.col("side").cast("int"), F.col("pos").cast("bigint"), F.col("vector").cast("array<double>"))
    sizes = rows.groupBy("pair").agg(*((F.max(F.when(F.col("side") == s, F.col("pos"))) / block).cast("int").alias(f"last_{s}") for s in (0, 1)))
    sides = []
    for side in (0, 1):
        own, other = F.floor(F.col("pos") / block).cast("int"), F.explode(F.sequence(F.lit(0), F.col(f"last_{1 - side}")))
        met = salted_join(rows.where(F.col("side") == side), sizes.where("last_0 IS NOT NULL AND last_1 IS NOT NULL"), ["pair"], ["pos"])
        met = met.select(F.col("pair").alias("pair"), own.alias("own"), other.alias("other"), F.col("pos").alias("pos"), F.col("vector").alias("vector"))
        low, high = ("own", "other") if side == 0 else ("other", "own")
        sides.append(met.select("pair", F.col(low).alias("low"), F.col(high).alias("high"), "pos", "vector").groupBy("pair", "low", "high"))
    best = sides[0].cogroup(sides[1]).applyInPandas(_best_cosines, "pair bigint, side int, pos bigint, best double")
    means = best.groupBy("pair", "side", "pos").agg(F.max("best").alias("best")).groupBy("pair").agg(
        F.avg(F.when(F.col("side") == 0, F.col("best"))).alias("precision"), F.avg(F.when(F.col("side") == 1, F.col("best"))).alias("recall")
    )
    return means.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def quality_band(f1: Column) -> Column:
    return F.when(f1 > 0.9, "excellent").when(f1 > 0.8, "good").when(f1 > 0.7, "moderate").otherwise("low")

"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target weight times the size of the mix, over the size of
the source (in characters). A document's number of copies is the Poisson quantile of a uniform number
hashed from the seed and its id, so it depends on nothing but the document, the seed and the rate: no
state, the same on every run and after a lost executor, and any number of copies can occur. Copies are
exploded and dealt out by a hash of (seed, id, copy), each partition sorted by it: a global shuffle.

A large rate is split into equal parts of at most ``PART``, drawn independently and added up, so the
first Poisson term does not vanish. The table of rates has one row per source; the join with it is salted by
document, so a hot source is dealt to ``SALTS`` tasks, and adaptive execution can split it further.

Cases: a null source is a source of its own, named by the empty string in ``weights``; a null text has
size 0 and is replicated like the others of its source; a source with size 0 has rate 1; a source that
is not in ``weights`` has weight 0 if weights are given, and without weights all sources weigh the same;
repeated rows count each, with the same number of copies; an empty table gives an empty result. A null
id hashes like an empty text. ``copy_no`` of the caller is replaced; all other columns come back as they are,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.functions.skew import salted_join
from quireworks.llm.common import table, unit_hash
from quireworks.staging import stage

SEED, PART, SALTS = "mix-1", 16.0, 16
#: Terms of the distribution beyond which less than 2**-53 remains for a rate of PART.
TERMS = 96


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(source_key, rate) for ``docs`` (source, text), whose lengths are read when this is called; weights are relative to each other."""
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("source_key")).agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("double").alias("chars"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.lit(1.0))
    else:
        wanted = docs.sparkSession.createDataFrame([(name, float(w)) for name, w in weights.items()], "source_key string, weight double")
        weighed = sizes.join(wanted, "source_key", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    weighed = stage(weighed, "source-weights")  # a row per source; the totals need no join with them
    all_weight, all_chars = (weighed.agg(F.sum(c)).scalar() for c in ("weight", "chars"))
    share = F.col("weight") / all_weight
    rate = F.when(F.col("chars") > 0, share * (F.lit(float(epochs)) * all_chars) / F.col("chars")).otherwise(F.lit(1.0))
    return weighed.select("source_key", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def _cumulated(rate: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS of a Poisson variable."""
    start = F.exp(-rate)
    zero = F.struct(start.alias("p"), start.alias("sum"), F.array(start).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)).cast("array<double>"), zero, step, lambda acc: acc["all"])


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """The columns of ``docs`` (doc_id, source, text, ...) with ``copy_no`` (from 1), each document by its Poisson count, shuffled."""
    columns = [c for c in docs.columns if c != "copy_no"]
    rates = source_rates(docs, weights, epochs).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    rates = rates.select("source_key", "parts", _cumulated(F.col("rate") / F.col("parts")).alias("cumulated"))
    # the caller's columns travel in one struct, so none of them can clash with a helper
    keyed = docs.select(F.struct(*columns).alias("row"), "doc_id", F.coalesce("source", F.lit("")).alias("source_key"))
    drawn = F.transform(
        F.sequence(F.lit(1), F.col("parts")),
        lambda part: F.size(F.filter("cumulated", lambda c: c <= unit_hash(F.lit(seed), F.col("doc_id"), part))),
    )
    copies = F.aggregate(drawn, F.lit(0), lambda a, b: a + b)
    counted = salted_join(keyed, rates, ["source_key"], ["doc_id"], salts=SALTS).withColumn("copies", copies).where(F.col("copies") > 0)
    spread = counted.select("row", "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    place = unit_hash(F.lit(seed), F.lit("place"), F.col("doc_id"), F.col("copy_no"))
    return spread.withColumn("place", place).repartition("place").sortWithinPartitions("place").select("row.*", "copy_no")


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as drawn, for equal shares of all sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars")
    return replicate(docs).select("doc_id", "source", "copy_no", F.length("text").alias("chars"))


SQL = f"""
WITH sizes AS (
    SELECT coalesce(source, '') AS source_key, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS chars FROM documents GROUP BY 1
), totals AS (
    SELECT CAST(count(*) AS DOUBLE) AS all_weight, sum(chars) AS all_chars FROM sizes
), rates AS (
    SELECT source_key, CASE WHEN chars > 0 THEN 1.0::DOUBLE / all_weight * all_chars / chars ELSE 1.0 END AS rate FROM sizes, totals
), parts AS (
    SELECT source_key, rate, CAST(greatest(1, ceil(rate / {PART})) AS INTEGER) AS parts FROM rates
), terms AS (
    SELECT source_key, parts, k, exp(-rate / parts) * coalesce(list_product(list_transform(range(1, k + 1), lambda i: (rate / parts) / i)), 1) AS p
    FROM parts, range(0, {TERMS + 1}) t(k)
), cumulated AS (
    SELECT source_key, parts, k, sum(p) OVER (PARTITION BY source_key ORDER BY k) AS c FROM terms
), lists AS (
    SELECT source_key, parts, list(c ORDER BY k) AS cs FROM cumulated GROUP BY ALL
), drawn AS (
    SELECT doc_id, source, length(text) AS chars, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(cs, lambda c:
        c <= CAST(CAST('0x' || substr(md5('{SEED}:' || doc_id || ':' || j), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496)))) AS copies
    FROM documents JOIN lists ON coalesce(source, '') = source_key
)
SELECT doc_id, source, CAST(copy_no AS INTEGER) AS copy_no, CAST(chars AS INTEGER) AS chars
FROM (SELECT doc_id, source, chars, unnest(range(1, CAST(copies AS BIGINT) + 1)) AS copy_no FROM drawn)
"""

"""How far the sources of each language lie apart in their words.

Terms are counted with Spark's ``CountVectorizer``, one model per language with a least document frequency
and the largest vocabulary size there is, so that it keeps every such term and its document vectors are
exact. As a vocabulary lives on the driver and is sent to the tasks, the terms of a language are dealt by
hash to as many models as keep each near ``MODEL_TERMS`` terms; how many terms there are is estimated over
all documents first (HyperLogLog). A document's vector is then in parts, one for each model.

A model is fitted on the documents, each with its distinct terms, as it is the documents of a term that decide.
Counts come from what the documents of a source have together in about two MB of text, a document of its own
for every power of two: it has the terms whose count there has that bit. So a term is looked up a few times
and not as often as it occurs, and the vectors' sums by their weights are the exact counts.

The vectors are written and read back as what they consist of (indices, values), added up per source, and
turned into smoothed shares, whole numbers of a billionth. Two sources are compared over blocks of terms:
a block's rows are the shares of the terms that occur, all others have the share of a count of zero. So no
join pairs the sources of a term, and no task holds more than ``BLOCK_CELLS`` shares for blocks of one term or more.

Cases: null text, lang and source count as empty strings; documents without terms and languages that keep no
term still have groups (all divergences are 0 where nothing is kept); repeated rows count each; texts of any
length are counted whole; an empty table gives no rows; columns other than text, lang and source are not
read. The names and estimates of the languages go to the driver, one row each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireworks.llm.common import slices, table, text_bytes
from quireworks.staging import fresh_path, stage

#: Documents of its language that a term must be in; terms of a model; shares a task compares at once; terms reported.
LEAST_DOCS, MODEL_TERMS, BLOCK_CELLS, TOP = 10, 2_000_000, 50_000, 10
#: Bytes of text whose terms are told apart together; the terms take some twenty times that room for a while.
TEXT_BYTES = 2 << 20
#: CountVectorizer takes this many terms at most: all of a model.
ALL_TERMS = 2**31 - 1
SCALE = 1_000_000_000
_VECTOR = "source string, weight bigint, parts struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"

_IN_TERM = np.zeros(256, bool)
_IN_TERM[0x41:0x5B] = _IN_TERM[0x61:0x7B] = _IN_TERM[0x80:] = True


def terms_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.DictionaryArray]]:
    """For about two MB of consecutive texts: the first row, the rows' numbers of terms, and the terms.

    A term is a run of letters A to Z and characters beyond ASCII; only A to Z are made small.
    """
    data, offsets = text_bytes(pc.ascii_lower(texts))
    for first, last in slices(offsets, TEXT_BYTES):
        part, rows = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        inside = _IN_TERM[part]
        cut = np.zeros(len(part) + 1, bool)  # a run ends at a row's end
        cut[1:-1] = inside[1:] != inside[:-1]
        cut[rows] = True
        bounds = np.flatnonzero(cut)
        runs = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(part)) if len(part) else pa.array([], pa.string())
        kept = inside[bounds[:-1]] if len(part) else np.zeros(0, bool)
        before = np.concatenate([[0], np.cumsum(kept)])
        counts = np.diff(before[np.searchsorted(bounds, rows)]) if len(part) else np.zeros(last - first, np.int64)
        yield first, counts, runs.filter(pa.array(kept)).dictionary_encode()


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term) once for about two MB of text."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for first, counts, terms in terms_of(batch.column("text")):
            number = np.repeat(np.asarray(langs.indices, np.int64)[first : first + len(counts)], counts)
            pairs = np.unique(number * len(terms.dictionary) + np.asarray(terms.indices, np.int64))
            lang, term = np.divmod(pairs, max(len(terms.dictionary), 1))
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), terms.dictionary.take(pa.array(term))], ["lang", "term"])


def _lists(term: np.ndarray, dictionary: pa.Array, *keys: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Where runs of equal ``keys`` begin, and the terms of each run."""
    new = np.zeros(len(term), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    begins = np.flatnonzero(new)
    words = dictionary.cast(pa.string()).take(pa.array(term))
    return begins, pa.ListArray.from_arrays(pa.array(np.concatenate([begins, [len(term)]]).astype(np.int32)), words)


def _dealt(models: dict[str, tuple[int, int, int]]):
    """(model, weight, lang_no, source, terms) for each model of a language.

    With weight 0 the distinct terms of a document. With others those that the documents of a source have
    together in about two MB of text: a term is in the rows whose weights add up to its count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = np.array([models[x] for x in batch.column("lang").to_pylist()], np.int64).reshape(-1, 3)
            sources = batch.column("source").dictionary_encode()
            group = chosen[:, 0] * max(len(sources.dictionary), 1) + np.asarray(sources.indices, np.int64)
            _, member, group = np.unique(group, return_index=True, return_inverse=True)  # a row of each group
            for first, counts, terms in terms_of(batch.column("text")):
                if not len(terms):
                    continue
                size = len(terms.dictionary)
                hashes = np.zeros(size, np.int64)
                if (chosen[:, 2] > 1).any():  # otherwise the terms of a document are together
                    hashes = np.fromiter((zlib.crc32(t.encode()) for t in terms.dictionary.to_pylist()), np.int64, size)
                row = np.repeat(np.arange(len(counts)) + first, counts)
                pairs, often = np.unique(row * size + np.asarray(terms.indices, np.int64), return_counts=True)
                row, term = np.divmod(pairs, size)
                together, which = np.unique(group[row] * size + term, return_inverse=True)
                often = np.bincount(which, often, len(together)).astype(np.int64)
                owner, added = np.divmod(together, size)
                layers = [(np.zeros(len(row), np.int64), row, term)]
                for bit in range(int(often.max()).bit_length()):
                    there = np.flatnonzero(often >> bit & 1)
                    layers.append((np.full(len(there), 1 << bit), member[owner[there]], added[there]))
                for weight, row, term in layers:
                    model = chosen[row, 1] + hashes[term] % chosen[row, 2]
                    order = np.lexsort((model, row))
                    row, model, term = row[order], model[order], term[order]
                    begins, lists = _lists(term, terms.dictionary, row, model)
                    at = row[begins]
                    columns = [pa.array(model[begins], pa.int32()), pa.array(weight[: len(begins)]), pa.array(chosen[at, 0], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*columns, batch.column("source").take(pa.array(at)), lists], ["model", "weight", "lang_no", "source", "terms"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, place, n): the sums of a batch of sparse vectors (source, weight, indices, values), as often as their weights say."""
    for batch in batches:
        sources, indices, values = batch.column("source").dictionary_encode(), batch.column("indices"), batch.column("values")
        lengths = np.asarray(indices.value_lengths(), np.int64)
        code, weight = (np.repeat(np.asarray(x, np.int64), lengths) for x in (sources.indices, batch.column("weight")))
        keys, which = np.unique(code << 32 | np.asarray(indices.flatten(), np.int64), return_inverse=True)
        n = np.bincount(which, np.asarray(values.flatten()) * weight, len(keys)).astype(np.int64)
        columns = [sources.dictionary.take(pa.array(keys >> 32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n)]
        yield pa.RecordBatch.from_arrays(columns, ["source", "place", "n"])


def plan_models(docs: DataFrame, model_terms: int = MODEL_TERMS) -> dict[str, tuple[int, int, int]]:
    """For each lang of ``docs`` (lang, text): its number, its first model and how many models it has."""
    names = docs.select("lang").distinct()
    estimate = docs.select("lang", "text").mapInArrow(_distinct, "lang string, term string").groupBy("lang").agg(F.approx_count_distinct("term").alias("n"))
    plan, used = {}, 0
    for number, row in enumerate(names.join(estimate, "lang", "left").orderBy("lang").collect()):
        share = max(1, -(-(row["n"] or 0) // model_terms))
        plan[row["lang"]] = (number, used, share)
        used += share
    return plan


def group_counts(docs: DataFrame, least_docs: int = LEAST_DOCS, model_terms: int = MODEL_TERMS) -> tuple[DataFrame, DataFrame]:
    """``docs`` (lang, source, text) as two tables: (lang_no, lang), and (lang_no, source, term, n), counts of kept terms."""
    spark = docs.sparkSession
    plan = plan_models(docs, model_terms)
    langs = spark.createDataFrame([(number, lang) for lang, (number, _, _) in plan.items()], "lang_no int, lang string")
    dealt = docs.mapInArrow(_dealt(plan), "model int, weight bigint, lang_no int, source string, terms array<string>")
    terms, vectors = fresh_path(spark, "terms"), fresh_path(spark, "vectors")
    dealt = dealt.withColumn("use", F.when(F.col("weight") == 0, "fit").otherwise("count"))
    dealt.write.option("compression", "zstd").partitionBy("model", "use").parquet(terms)
    written = spark.read.schema("weight bigint, lang_no int, source string, terms array<string>, model int, use string").parquet(terms)
    counted = None
    for model, lang_no in sorted(tuple(r) for r in written.groupBy("model").agg(F.first("lang_no")).collect()):
        rows, summed = (written.where((F.col("model") == model) & (F.col("use") == use)) for use in ("fit", "count"))
        try:
            fitted = CountVectorizer(inputCol="terms", outputCol="parts", minDF=least_docs, vocabSize=ALL_TERMS).fit(rows)
        except IllegalArgumentException as nothing:  # no term is in enough documents
            if "vocabulary size" not in str(nothing):
                raise
            continue
        fitted.transform(summed).select("source", "weight", "parts").write.parquet(f"{vectors}/{model}")
        fitted.save(f"{vectors}/{model}-terms")
        vocabulary = spark.read.parquet(f"{vectors}/{model}-terms/data").select(F.posexplode("vocabulary").alias("place", "term"))
        exact = spark.read.schema(_VECTOR).parquet(f"{vectors}/{model}").select("source", "weight", "parts.indices", "parts.values")
        sums = exact.mapInArrow(_sums, "source string, place int, n bigint").groupBy("source", "place").agg(F.sum("n").alias("n"))
        part = sums.join(vocabulary, "place").select(F.lit(lang_no).cast("int").alias("lang_no"), "source", "term", "n")
        counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        counted = spark.createDataFrame([], "lang_no int, source string, term string, n bigint")
    return langs, stage(counted, "counts")


def _share(n: str, total: str) -> str:
    """Exact for any count: the product is a decimal."""
    return f"1 + ({SCALE}BD * ({n} + 2)) div ({total} + 2 * kept)"


def _compare(key: tuple, shares: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Sums over a block's terms of (p - q)^2 div (p + q) for every two sources."""
    names = sources["source"].to_numpy()
    row = {s: i for i, s in enumerate(names)}
    place, terms = pd.factorize(shares["term"])
    p = np.repeat(sources["p0"].to_numpy(np.int64)[:, None], len(terms), axis=1)
    p[shares["source"].map(row).to_numpy(np.int64), place] = shares["p"].to_numpy(np.int64)
    found = []
    for i in range(len(names) - 1):
        less, more = p[i] - p[i + 1 :], p[i] + p[i + 1 :]
        found.append((less * less // more).sum(axis=1))
    a, b = np.triu_indices(len(names), 1)
    f = np.concatenate([np.zeros(0, np.int64), *found])
    both = (np.concatenate([a, b]), np.concatenate([b, a]))
    return pd.DataFrame({"lang_no": np.int32(key[0]), "source": names[both[0]], "item": names[both[1]], "f": np.concatenate([f, f])})


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, model_terms: int = MODEL_TERMS, cells: int = BLOCK_CELLS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``docs`` (text, lang, source).

    Part ``pair``: every other source of the language with its divergence. Part ``term``: the ``top`` terms
    that a source uses more than its language does. Ties go to the smaller item.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    langs, counts = group_counts(docs, least_docs, model_terms)
    overall = stage(counts.groupBy("lang_no", "term").agg(F.sum("n").alias("all_n")), "terms_of_langs")
    sizes = overall.groupBy("lang_no").agg(F.count(F.lit(1)).alias("kept"), F.sum("all_n").alias("all_total"))
    totals = counts.groupBy("lang_no", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang").join(sizes, "lang_no", "left").join(totals, ["lang_no", "source"], "left")
    groups = groups.select("lang_no", "lang", "source", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("kept", "all_total", "total")))
    groups = stage(groups, "groups")
    many = groups.groupBy("lang_no").agg(F.count(F.lit(1)).alias("sources"))

    shares = counts.join(groups, ["lang_no", "source"]).join(overall, ["lang_no", "term"]).join(many, "lang_no")
    shares = shares.select(
        "lang_no", "lang", "source", "term", F.expr(_share("n", "total")).alias("p"), F.expr(_share("all_n", "all_total")).alias("q"),
        F.expr(f"pmod(xxhash64(term), greatest(1, kept * sources div {cells} + 1))").alias("block"),
    )
    shares = stage(shares, "shares")
    zero = groups.where("kept > 0").select("lang_no", "source", F.expr(_share("0", "total")).alias("p0"))
    blocks = stage(shares.select("lang_no", "block").distinct().join(zero, "lang_no"), "blocks")
    cells_of = shares.select("lang_no", "block", "source", "term", "p").groupBy("lang_no", "block")
    compared = cells_of.cogroup(blocks.groupBy("lang_no", "block")).applyInPandas(_compare, "lang_no int, source string, item string, f bigint")
    # every two sources have a row, those without any kept term in their language as well
    nothing = groups.where("kept = 0").select("lang_no", "lang", "source")
    none = nothing.join(nothing.select("lang_no", F.col("source").alias("item")), "lang_no").where("source <> item").select("lang", "source", "item", F.lit(0).cast("bigint").alias("value"))
    pairs = compared.groupBy("lang_no", "source", "item").agg(F.sum("f").alias("value")).join(langs, "lang_no").select("lang", "source", "item", "value").unionByName(none)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH rows_of AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM rows_of
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM rows_of) g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

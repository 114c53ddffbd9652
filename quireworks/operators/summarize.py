"""Extractive summaries: sentences ranked by closeness to the centre of their text.

Everything is keyed by (doc_id, section). The text is spread by doc_id once, while it is
still compact, over as many tasks as its length asks for, and every window and aggregate after that finds its rows in place. A
group is never larger than one document's text, which is one input row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireworks.functions import centre
from quireworks.functions import text as tx
from quireworks.functions import vectors as vec
from quireworks.functions.skew import salted_join, tasks_for

GROUP = ("doc_id", "section")
SHORT_TEXT_WORDS = 50
SECTION_RATIO = 0.4
LONG_SECTIONS = ("introduction", "conclusion")


def section_budget(section: Column) -> Column:
    """Words a section summary may have."""
    return F.when(section.isin(*LONG_SECTIONS), F.lit(200)).otherwise(F.lit(150))


def keep_count(n: Column, ratio: float) -> Column:
    """max(3, floor(n * ratio)); the product is taken in exact decimals."""
    return F.greatest(F.lit(3), F.floor(n * F.lit(f"{ratio:.4f}").cast("decimal(6,4)"))).cast("int")


def _candidates(texts: DataFrame, abbreviations: Sequence[str], cleaned: bool = False) -> DataFrame:
    """Add ``cand`` (array of pos, sentence, words), ``n_cand`` and ``ranked``.

    Texts with fewer than three sentences, or none of good quality, pass through whole:
    all their sentences are candidates and keep their order. A text marked ``is_short``
    is one candidate as it stands. The words of ``cleaned`` texts lie one space apart.
    """
    sentences = tx.sentences(F.col("text"), abbreviations)
    if "is_short" in texts.columns:
        sentences = F.when(F.col("is_short"), F.array("text")).otherwise(sentences)
    good = F.filter("_all", lambda x: F.length(x["sentence"]).between(31, 499) & (x["words"] >= 5))
    return (
        texts.withColumn("_sentences", sentences)
        .withColumn(
            "_all",
            F.transform(
                "_sentences",
                lambda s, i: F.struct(i.alias("pos"), s.alias("sentence"), (tx.cleaned_word_count(s) if cleaned else tx.word_count(s)).alias("words")),
            ),
        )
        .withColumn("_good", good)
        .withColumn("ranked", (F.size("_all") >= 3) & (F.size("_good") > 0))
        .withColumn("cand", F.when(F.col("ranked"), F.col("_good")).otherwise(F.col("_all")))
        .withColumn("n_cand", F.size("cand"))
        .drop("text", "_sentences", "_all", "_good")
    )


def sentence_rows(
    texts: DataFrame, keys: Sequence[str] = GROUP, abbreviations: Sequence[str] = (), spread_by: str | None = "doc_id"
) -> DataFrame:
    """(keys, ranked, n_cand, pos, sentence, words): the candidate sentences, one per row."""
    extra = ["is_short"] if "is_short" in texts.columns else []
    texts = texts.select(*keys, *extra, "text")
    # explode_outer: an inner explode would make Spark test the array, and so build it, once more beforehand
    return (
        _candidates(texts.repartition(tasks_for(texts), spread_by) if spread_by else texts, abbreviations)
        .select(*keys, *extra, "ranked", "n_cand", F.explode_outer("cand").alias("c"))
        .where("c.pos is not null")
        .select(*keys, *extra, "ranked", "n_cand", "c.pos", "c.sentence", "c.words")
    )


def _with_term_frequencies(sentences: DataFrame) -> DataFrame:
    """Add ``terms``, an array of (term, tf), to ranked sentences.

    In the sorted words a term reaches up to where the next one starts. Each step is a
    column of its own, so that it is computed once and not once per element.
    """
    after = F.concat(F.slice("_start", F.lit(2), F.size("_start")), F.array((F.size("_words") + 1).cast("bigint")))
    return (
        sentences.withColumn("_words", F.when(F.col("ranked"), F.sort_array(tx.tokens(F.col("sentence")))))
        .withColumn("_distinct", F.array_distinct("_words"))
        .withColumn("_start", F.transform("_distinct", lambda t: F.array_position("_words", t)))
        .withColumn("_tf", F.zip_with("_start", after, lambda a, b: b - a))
        .withColumn("terms", F.arrays_zip(F.col("_distinct").alias("term"), F.col("_tf").alias("tf")))
        .drop("_words", "_distinct", "_start", "_tf")
    )


def score_sentences(
    texts: DataFrame, keys: Sequence[str] = GROUP, abbreviations: Sequence[str] = (), spread_by: str | None = "doc_id"
) -> DataFrame:
    """(keys, pos, sentence, words, ranked, n_cand, score) of all candidate sentences.

    A sentence is a vector of tf * (ln((1+n)/(1+df)) + 1) with df counted over the n
    candidates of its own text; the score is its cosine to their mean, to nine digits.
    It is null where the text passes through unranked.

    The mean's squared length is the mean of the dot products with it, so it needs no
    vector of its own. The sentence travels on the row of its first term, so no join
    has to bring it back. Pass ``spread_by=None`` if the texts already lie by document.
    """
    keys = list(keys)
    rows = sentence_rows(texts, keys, abbreviations, spread_by)
    extra = ["is_short"] if "is_short" in rows.columns else []
    token_rows = (
        _with_term_frequencies(rows)
        .select(*keys, *extra, "pos", "ranked", "n_cand", "sentence", "words", F.posexplode_outer("terms").alias("i", "t"))
        .withColumn("first", F.coalesce("i", F.lit(0)) == 0)
        .withColumn("sentence", F.when(F.col("first"), F.col("sentence")))
        .withColumns({"term": F.col("t.term"), "tf": F.col("t.tf")})
        .drop("i", "t", "first")
    )
    same_term = Window.partitionBy(*keys, "term")
    idf = F.log((F.col("n_cand") + 1.0) / (F.col("df") + 1.0)) + 1.0
    weighted = (
        token_rows.withColumn("df", F.count("*").over(same_term))
        .withColumn("w", F.when(F.col("term").isNotNull(), F.col("tf") * idf).otherwise(F.lit(0.0)))
        .withColumn("centre", F.sum("w").over(same_term) / F.col("n_cand"))
    )
    constant = [*extra, "ranked", "n_cand", "words", "sentence"]
    per_sentence = weighted.groupBy(*keys, "pos").agg(
        *(F.max(c).alias(c) for c in constant),
        F.sum(F.col("w") * F.col("centre")).alias("dot"),
        F.sum(F.col("w") * F.col("w")).alias("sq"),
    )
    centre_sq = F.sum("dot").over(Window.partitionBy(*keys)) / F.col("n_cand")
    length = F.sqrt(F.col("sq") * F.col("centre_sq"))
    cosine = F.when(length > 0, F.col("dot") / length).otherwise(F.lit(0.0))
    return (
        per_sentence.withColumn("centre_sq", centre_sq)
        .withColumn("score", F.when(F.col("ranked"), F.round(cosine, 9)))
        .drop("dot", "sq", "centre_sq")
    )


def score_by_vectors(sentences: DataFrame, vector: str = "vector", keys: Sequence[str] = GROUP) -> DataFrame:
    """Replace ``vector`` by ``score``, its cosine to the mean vector of the sentence's text.

    For vectors that an encoder supplied, see :func:`encode`. The mean comes from sums per dimension that
    merge map-side, so a text may have any number of sentences; it joins them salted, so they stay spread.
    """
    others = [c for c in sentences.columns if c not in (*keys, vector)]
    scored = cosine_to_centroid(sentences, keys, vector)
    return scored.select(*keys, *others, F.round("score", 9).alias("score"))


def encode(sentences: DataFrame, encoder: Column, vector: str = "vector") -> DataFrame:
    """Add vectors from a sentence encoder: a ``pandas_udf`` from text to ``array<float>`` applied to ``sentence``.

    The encoder runs on Arrow batches inside the tasks, so a model can be loaded once per worker.
    """
    return sentences.withColumn(vector, encoder)


def select_top(scored: DataFrame, ratio: float, keys: Sequence[str] = GROUP) -> DataFrame:
    """Keep the best max(3, floor(n * ratio)) sentences per text and add ``rank``.

    Equal scores rank by position. Unranked texts keep all sentences in order.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("score"), "pos")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.where(~F.col("ranked") | (F.col("rank") <= keep_count(F.col("n_cand"), ratio)))


def within_budget(selected: DataFrame, budget: Column, keys: Sequence[str] = GROUP) -> DataFrame:
    """Keep sentences, best first, while their words fit the budget; the best one always stays."""
    # the order of select_top, so that its sort serves both windows
    so_far = (
        Window.partitionBy(*keys)
        .orderBy(F.desc_nulls_last("score"), "pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        selected.withColumn("_total", F.sum("words").over(so_far))
        .where((F.col("_total") <= budget) | (F.col("rank") == 1))
        .drop("_total")
    )


def in_source_order(selected: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """(keys, summary): the selected sentences of each text in their original order."""
    item = F.struct("pos", F.col("sentence").alias("text"))
    return selected.groupBy(*keys).agg(tx.ordered_join(F.collect_list(item), " ").alias("summary"))


def _scored_in_row(candidates: DataFrame) -> DataFrame:
    """Add ``scores`` to rows of :func:`_candidates`: the scores of :func:`score_sentences` for ``cand``, null where a text is not ranked.

    The sentences of a text stay in its row; no word is a row.
    """
    asked = F.when(F.col("ranked"), F.transform("cand", lambda c: F.lower(c["sentence"])))
    schema = T.StructType([*candidates.schema.fields, T.StructField("scores", T.ArrayType(T.DoubleType()))])
    return candidates.withColumn("_lower", asked).mapInArrow(centre.score_batches, schema)


def _best_in_row(ratio: float, budget: Column) -> Column:
    """The summary from ``cand`` and ``scores``: :func:`select_top`, :func:`within_budget` and :func:`in_source_order` inside the row.

    Words never take away from a sum, so what fits the budget is a first part of the sentences, best first.
    """
    def item(c: Column, minus: Column) -> Column:
        return F.struct(minus.alias("minus"), c["pos"].alias("pos"), c["words"].cast("bigint").alias("words"), c["sentence"].alias("sentence"))

    by_score = F.zip_with("cand", "scores", lambda c, s: item(c, -F.round(s, 9)))
    ordered = F.when(F.col("ranked"), F.slice(F.sort_array(by_score), F.lit(1), keep_count(F.col("n_cand"), ratio))).otherwise(F.transform("cand", lambda c: item(c, F.lit(0.0))))

    def fitting(acc: Column, x: Column) -> Column:
        total = acc["total"] + x["words"]
        return F.struct(total.alias("total"), (acc["n"] + (total <= budget).cast("int")).alias("n"))

    def summary(best: Column) -> Column:
        none = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("n"))
        kept = F.slice(best, F.lit(1), F.greatest(F.lit(1), F.aggregate(best, none, fitting, lambda acc: acc["n"])))
        return tx.ordered_join(F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), x["sentence"].alias("text"))), " ")

    return F.get(F.transform(F.array(ordered), summary), F.lit(0))  # a variable of its own, so that it is sorted once


def extractive_summary(
    texts: DataFrame,
    ratio: float = 0.3,
    keys: Sequence[str] = GROUP,
    abbreviations: Sequence[str] = (),
    spread_by: str | None = "doc_id",
) -> DataFrame:
    """(keys, summary): the best share of each text's sentences in source order."""
    return in_source_order(select_top(score_sentences(texts, keys, abbreviations, spread_by), ratio, keys), keys)


def summarize_sections(
    sections: DataFrame, abbreviations: Sequence[str] = (), spread_by: str | None = "doc_id"
) -> DataFrame:
    """(doc_id, section, section_order, summary, is_short) of every non-empty section.

    Sections under 50 cleaned words come back cleaned as they are and get no keywords;
    they are not ranked. The rest is ranked, cut to its word budget and tidied.
    """
    keys = ["doc_id", "section", "section_order"]
    texts = sections.where(F.col("text") != "").select(*keys, "text")
    if spread_by:
        texts = texts.repartition(tasks_for(texts), spread_by)
    cleaned = texts.withColumn("text", tx.clean_text(F.col("text"))).withColumn(
        "is_short", tx.cleaned_word_count(F.col("text")) < SHORT_TEXT_WORDS
    )
    # filtered after the scores: before them Spark would build the candidates once more to test them
    scored = _scored_in_row(_candidates(cleaned, abbreviations, cleaned=True)).where("n_cand > 0")
    joined = scored.select(*keys, "is_short", _best_in_row(SECTION_RATIO, section_budget(F.col("section"))).alias("summary"))
    tidied = F.when(F.col("is_short"), F.col("summary")).otherwise(tx.clean_summary(F.col("summary")))
    return joined.withColumn("summary", tidied)


def roll_up(section_summaries: DataFrame) -> DataFrame:
    """(doc_id, overall_summary): section summaries joined in section order."""
    item = F.struct("section_order", F.col("summary").alias("text"))
    return section_summaries.groupBy("doc_id").agg(
        tx.ordered_join(F.collect_list(item), " ").alias("overall_summary")
    )


def compression_percent(original_words: Column, summary_words: Column) -> Column:
    """(1 - summary/original) * 100 with one decimal; null without original words."""
    return F.round((1 - F.try_divide(summary_words.cast("double"), original_words.cast("double"))) * 100, 1)


def dense_centroids(vectors: DataFrame, group: str | Sequence[str], vector: str) -> DataFrame:
    """Mean vector per group. Sums merge map-side per dimension, so large groups are no burden."""
    group = [group] if isinstance(group, str) else list(group)
    by_dim = vectors.select(*group, F.posexplode(vector).alias("dim", "x")).groupBy(*group, "dim").agg(
        F.avg(F.col("x").cast("double")).alias("text")
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("dim", "text"))), lambda x: x["text"])
    return by_dim.groupBy(*group).agg(ordered.alias("centroid"))


def cosine_to_centroid(vectors: DataFrame, group: str | Sequence[str], vector: str) -> DataFrame:
    """Add ``score``: cosine of each vector to the centroid of its group."""
    group = [group] if isinstance(group, str) else list(group)
    return (
        salted_join(vectors, dense_centroids(vectors, group, vector), group, [vector], "left")
        .withColumn("score", vec.cosine(F.col(vector), F.col("centroid")))
        .drop("centroid")
    )


def comparison_table(records: DataFrame) -> DataFrame:
    """One row per paper record with its sizes and counts."""
    return records.select(
        "doc_id",
        tx.short_title(F.col("title")).alias("title"),
        F.col("num_words_original").alias("words_original"),
        F.col("num_words_summary").alias("words_summary"),
        compression_percent(F.col("num_words_original"), F.col("num_words_summary")).alias("compression_percent"),
        F.size("sections_found").alias("n_sections"),
        F.size("overall_keywords").alias("n_keywords"),
        F.size("entities.datasets").alias("n_datasets"),
        F.size("entities.models").alias("n_models"),
    )

"""Text scalars, entities, steps, keywords and scores on document texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quireworks.checks import planted, sql
from quireworks.checks.registry import ORACLES, query
from quireworks.checks.sql import build
from quireworks.functions import text as tx

from quireworks.operators import entities, evaluate, flow, keywords, summarize


@query("word_count", f"SELECT doc_id, {sql.word_count('text')} AS n_words, len(string_split(text, ' ')) AS n_spaced FROM documents")
def word_count(spark, sf_dir):
    return planted.documents(spark, sf_dir).select(
        "doc_id",
        tx.word_count(F.col("text")).cast("bigint").alias("n_words"),
        F.size(F.split("text", " ")).cast("bigint").alias("n_spaced"),
    )


@query("clean_text", build(f"SELECT doc_id, {sql.clean_text('text')} AS text FROM planted_text", "planted_text"))
def clean_text(spark, sf_dir):
    return planted.planted_texts(spark, sf_dir).select("doc_id", tx.clean_text(F.col("text")).alias("text"))


@query(
    "sentence_split",
    f"SELECT doc_id, pos - 1 AS pos, sentence FROM documents, unnest({sql.sentences('text')}) WITH ORDINALITY AS u(sentence, pos)",
)
def sentence_split(spark, sf_dir):
    docs = planted.documents(spark, sf_dir)
    split = docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    return split.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "quality_sentences",
    f"""SELECT doc_id, pos - 1 AS pos, sentence FROM documents, unnest({sql.sentences('text')}) WITH ORDINALITY AS u(sentence, pos)
    WHERE length(sentence) > 30 AND length(sentence) < 500 AND {sql.word_count('sentence')} >= 5""",
)
def quality_sentences(spark, sf_dir):
    return sentence_split(spark, sf_dir).where(tx.is_quality_sentence(F.col("sentence")))


@query("clean_summary", build(f"SELECT doc_id, {sql.clean_summary('text')} AS summary FROM planted_text", "planted_text"))
def clean_summary(spark, sf_dir):
    return planted.planted_texts(spark, sf_dir).select("doc_id", tx.clean_summary(F.col("text")).alias("summary"))


@query(
    "extract_paper_id",
    build(
        r"SELECT doc_id, nullif(regexp_extract(text, '(\d{4}\.\d{4,5}(v\d+)?)', 1), '') AS paper_id FROM planted_text",
        "planted_text",
    ),
)
def extract_paper_id(spark, sf_dir):
    return planted.planted_texts(spark, sf_dir).select("doc_id", tx.paper_id(F.col("text")).alias("paper_id"))


@query("last_path_part", "SELECT page_id, string_split(url, '/')[-1] AS last_part FROM pages")
def last_path_part(spark, sf_dir):
    return planted.table(spark, sf_dir, "pages").select("page_id", tx.last_path_part(F.col("url")).alias("last_part"))


@query(
    "display_strings",
    """SELECT doc_id, array_to_string(string_split(text, ' ')[1:3], ', ') ||
        CASE WHEN len(string_split(text, ' ')) > 3 THEN ' +' || (len(string_split(text, ' ')) - 3) || ' more' ELSE '' END AS authors,
        substr(text, 1, 50) || '...' AS title, upper(lang[1]) || lang[2:] || ' ' || upper(source[1]) || source[2:] AS label FROM documents""",
)
def display_strings(spark, sf_dir):
    return planted.documents(spark, sf_dir).select(
        "doc_id",
        tx.author_line(F.split("text", " ")).alias("authors"),
        tx.short_title(F.col("text")).alias("title"),
        tx.label_from_key(F.concat_ws("_", "lang", "source")).alias("label"),
    )


_AGE = """SELECT {key}, CASE
    WHEN d < 7 THEN d || ' day' || CASE WHEN d > 1 THEN 's' ELSE '' END || ' ago'
    WHEN d < 30 THEN (d // 7) || ' week' || CASE WHEN d // 7 > 1 THEN 's' ELSE '' END || ' ago'
    WHEN d < 365 THEN (d // 30) || ' month' || CASE WHEN d // 30 > 1 THEN 's' ELSE '' END || ' ago'
    ELSE (d // 365) || ' year' || CASE WHEN d // 365 > 1 THEN 's' ELSE '' END || ' ago' END AS age
    FROM (SELECT {key}, (abs(epoch_us(TIMESTAMP '{as_of}') - epoch_us({at})) + 86399999999) // 86400000000 AS d FROM {table})"""


@query("age_bucket", _AGE.format(key="o_orderkey", at="o_orderdate", table="orders", as_of="2001-08-03 00:00:00"))
def age_bucket(spark, sf_dir):
    as_of = F.lit("2001-08-03 00:00:00").cast("timestamp")
    return planted.table(spark, sf_dir, "orders").select("o_orderkey", tx.age_label(F.col("o_orderdate"), as_of).alias("age"))


@query("age_bucket_recent", _AGE.format(key="event_id", at="ts", table="events", as_of="2024-01-31 00:00:00"))
def age_bucket_recent(spark, sf_dir):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return planted.table(spark, sf_dir, "events").select("event_id", tx.age_label(F.col("ts"), as_of).alias("age"))


@query(
    "entity_extract",
    build("SELECT doc_id, type, entity, count(*) AS n FROM mentions GROUP BY ALL", "mentions", entity_input="SELECT * FROM planted_text"),
)
def entity_extract(spark, sf_dir):
    found = entities.mentions(planted.planted_texts(spark, sf_dir))
    return found.groupBy("doc_id", "type", "entity").agg(F.count("*").alias("n"))


@query(
    "entity_rank_topn",
    build("SELECT doc_id, type, entity, freq, rank FROM entity_ranks", "entity_ranks", entity_input="SELECT * FROM planted_text"),
)
def entity_rank_topn(spark, sf_dir):
    return entities.rank(planted.planted_texts(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "entity_fill",
    build(
        """SELECT d.doc_id, t.type, coalesce(string_agg(r.entity, ',' ORDER BY r.rank), '') AS names
        FROM entity_input d CROSS JOIN entity_types t LEFT JOIN entity_ranks r ON r.doc_id = d.doc_id AND r.type = t.type
        GROUP BY d.doc_id, t.type""",
        "entity_types",
        "entity_ranks",
        entity_input="SELECT * FROM planted_text",
    ),
)
def entity_fill(spark, sf_dir):
    found = entities.with_entities(planted.planted_texts(spark, sf_dir))
    return found.select("doc_id", F.explode(entities.entity_map()).alias("type", "found")).select(
        "doc_id", "type", F.array_join("found", ",").alias("names")
    )


@query("flow_steps", build("SELECT doc_id, step_no, step FROM steps", "steps", method="SELECT * FROM planted_first"))
def flow_steps(spark, sf_dir):
    found = flow.steps(planted.planted_texts(spark, sf_dir, first=True))
    return found.withColumn("step_no", F.col("step_no").cast("bigint"))


@query("flow_edges", build("SELECT doc_id, edge_no, source, target FROM flow_edges", "flow_edges", method="SELECT * FROM planted_first"))
def flow_edges(spark, sf_dir):
    found = flow.edges(planted.planted_texts(spark, sf_dir, first=True))
    return found.withColumn("edge_no", F.col("edge_no").cast("bigint"))


@query("flow_mermaid", build("SELECT doc_id, chart FROM charts", "charts", method="SELECT * FROM planted_first"))
def flow_mermaid(spark, sf_dir):
    docs = flow.with_steps(planted.planted_texts(spark, sf_dir, first=True)).where("steps is not null")
    return docs.select("doc_id", flow.mermaid(F.col("steps")).alias("chart"))


_WHOLE = "SELECT doc_id, 'all' AS section, 0 AS section_order, text FROM documents"


def whole_texts(spark, sf_dir):
    """Documents as one section each."""
    return planted.table(spark, sf_dir, "documents").select("doc_id", F.lit("all").alias("section"), "text")


@query(
    "sentence_scores",
    build("SELECT doc_id, pos, ranked, round(score, 6) AS score FROM sentence_scores", "sentence_scores", texts=_WHOLE),
)
def sentence_scores(spark, sf_dir):
    scored = summarize.score_sentences(whole_texts(spark, sf_dir))
    return scored.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "ranked", F.round("score", 6).alias("score"))


@query(
    "topn_by_ratio",
    build("SELECT doc_id, pos, rank FROM top_sentences", "top_sentences", texts=_WHOLE),
)
def topn_by_ratio(spark, sf_dir):
    top = summarize.select_top(summarize.score_sentences(whole_texts(spark, sf_dir)), summarize.SECTION_RATIO)
    return top.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "extractive_summary",
    build(
        """SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM sentence_ranks
        WHERE NOT ranked OR rank <= greatest(3, n_cand * 3 // 10) GROUP BY doc_id""",
        "sentence_ranks",
        texts=_WHOLE,
    ),
)
def extractive_summary(spark, sf_dir):
    return summarize.extractive_summary(whole_texts(spark, sf_dir), 0.3).select("doc_id", "summary")


@query(
    "budget_summary",
    build("SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM budgeted GROUP BY doc_id", "budgeted", texts=_WHOLE),
)
def budget_summary(spark, sf_dir):
    top = summarize.select_top(summarize.score_sentences(whole_texts(spark, sf_dir)), summarize.SECTION_RATIO)
    kept = summarize.within_budget(top, summarize.section_budget(F.col("section")))
    return summarize.in_source_order(kept).select("doc_id", "summary")


@query(
    "compression_ratio",
    build(
        f"""SELECT doc_id, round((1.0::DOUBLE - {sql.word_count('c')}::DOUBLE / nullif({sql.word_count('t')}, 0)) * 100, 1) AS compression
        FROM (SELECT doc_id, text AS t, {sql.clean_text('text')} AS c FROM planted_text)""",
        "planted_text",
    ),
)
def compression_ratio(spark, sf_dir):
    texts = planted.planted_texts(spark, sf_dir)
    shorter = tx.word_count(tx.clean_text(F.col("text")))
    return texts.select(
        "doc_id", summarize.compression_percent(tx.word_count(F.col("text")), shorter).alias("compression")
    )


@query(
    "keyword_topk_doc",
    build(
        "SELECT doc_id, term, round(score, 6) AS score, rank FROM keyword_ranks WHERE rank <= 10",
        "keyword_ranks",
        keyword_input="SELECT doc_id, 'all' AS section, text FROM documents",
    ),
)
def keyword_topk_doc(spark, sf_dir):
    top = keywords.top_keywords(planted.table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], 10)
    return top.select("doc_id", "term", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "centroid",
    "SELECT label, dim, round(avg(x), 6) AS mean FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL",
)
def centroid(spark, sf_dir):
    centroids = summarize.dense_centroids(planted.table(spark, sf_dir, "embeddings"), "label", "embedding")
    return centroids.select("label", F.posexplode("centroid").alias("dim", "mean")).select(
        "label", F.col("dim").cast("bigint").alias("dim"), F.round("mean", 6).alias("mean")
    )


@query(
    "centroid_cosine",
    """WITH c AS (SELECT label, list(m ORDER BY dim) AS centroid FROM (
        SELECT label, dim, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL) GROUP BY label)
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) AS score FROM embeddings JOIN c USING (label)""",
)
def centroid_cosine(spark, sf_dir):
    scored = summarize.cosine_to_centroid(planted.table(spark, sf_dir, "embeddings"), "label", "embedding")
    return scored.select("vec_id", F.round("score", 6).alias("score"))


_VOWELS = "aeiou"


def _vowel_encoder():
    """A stand-in for a sentence encoder: how often each vowel occurs."""
    @F.pandas_udf("array<float>")
    def encoder(sentence: pd.Series) -> pd.Series:
        return pd.DataFrame({v: sentence.str.count(v) for v in _VOWELS}).astype("float32").apply(list, axis=1)

    return encoder


_COUNTS = ", ".join(f"(length(sentence) - length(replace(sentence, '{v}', '')))::DOUBLE" for v in _VOWELS)


@query(
    "encoder_scores",
    build(
        f"""SELECT v.doc_id, v.pos, round(round(coalesce(CASE WHEN isnan(c) THEN 0 ELSE c END, 0), 9), 6) AS score FROM (
            SELECT v.doc_id, v.pos, list_cosine_similarity(v.e, m.centre) AS c
            FROM (SELECT doc_id, pos, [{_COUNTS}] AS e FROM candidates) v
            JOIN (SELECT doc_id, [{', '.join(f'avg(e[{i + 1}])' for i in range(len(_VOWELS)))}] AS centre
                  FROM (SELECT doc_id, [{_COUNTS}] AS e FROM candidates) GROUP BY doc_id) m ON m.doc_id = v.doc_id) v""",
        "candidates",
        texts=_WHOLE,
    ),
)
def encoder_scores(spark, sf_dir):
    """Sentences ranked by the vectors of a plugged-in encoder."""
    rows = summarize.sentence_rows(whole_texts(spark, sf_dir)).select("doc_id", "section", "pos", "sentence")
    scored = summarize.score_by_vectors(summarize.encode(rows, _vowel_encoder()(F.col("sentence"))))
    return scored.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.round("score", 6).alias("score"))


_TURN_PAIRS = """SELECT a.conv_id, a.turn, a.text AS cand, b.text AS ref FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""
_OVERLAP = f"""
    WITH pairs AS ({_TURN_PAIRS}),
    c AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest({sql.tokens('cand')}) AS t FROM pairs) GROUP BY ALL),
    r AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest({sql.tokens('ref')}) AS t FROM pairs) GROUP BY ALL),
    counts AS (
        SELECT p.conv_id, p.turn, coalesce(o.n, 0) AS n_overlap, coalesce(cs.n, 0) AS n_candidate, coalesce(rs.n, 0) AS n_reference
        FROM pairs p
        LEFT JOIN (SELECT c.conv_id, c.turn, sum(least(c.n, r.n))::BIGINT AS n FROM c JOIN r USING (conv_id, turn, t) GROUP BY ALL) o USING (conv_id, turn)
        LEFT JOIN (SELECT conv_id, turn, sum(n)::BIGINT AS n FROM c GROUP BY ALL) cs USING (conv_id, turn)
        LEFT JOIN (SELECT conv_id, turn, sum(n)::BIGINT AS n FROM r GROUP BY ALL) rs USING (conv_id, turn)
        WHERE p.cand <> '' AND p.ref <> ''),
    scores AS (
        SELECT *, coalesce(n_overlap::DOUBLE / nullif(n_candidate, 0), 0) AS precision, coalesce(n_overlap::DOUBLE / nullif(n_reference, 0), 0) AS recall FROM counts),
    scored AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM scores)
"""


def _turn_pairs(spark, sf_dir):
    turns = planted.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    pairs = turns.withColumnRenamed("text", "cand").join(after, ["conv_id", "turn"])
    return pairs.withColumn("pair", F.struct("conv_id", "turn"))


@query(
    "unigram_overlap",
    _OVERLAP + "SELECT conv_id, turn, n_overlap, n_candidate, n_reference, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM scored",
)
def unigram_overlap(spark, sf_dir):
    scored = evaluate.unigram_overlap(_turn_pairs(spark, sf_dir), "pair", "cand", "ref")
    return scored.select(
        "pair.conv_id", "pair.turn", "n_overlap", "n_candidate", "n_reference",
        *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")),
    )


@query(
    "quality_band",
    _OVERLAP + "SELECT conv_id, turn, CASE WHEN f1 > 0.9 THEN 'excellent' WHEN f1 > 0.8 THEN 'good' WHEN f1 > 0.7 THEN 'moderate' ELSE 'low' END AS band FROM scored",
)
def quality_band(spark, sf_dir):
    scored = evaluate.unigram_overlap(_turn_pairs(spark, sf_dir), "pair", "cand", "ref")
    return scored.select("pair.conv_id", "pair.turn", evaluate.quality_band(F.col("f1")).alias("band"))


# Eight vectors at a time stand for the tokens of a text; text 2n is scored against text 2n + 1.
@query(
    "greedy_match",
    """WITH v AS (SELECT vec_id // 16 AS pair, (vec_id // 8) % 2 AS side, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT a.pair, a.vec_id AS c, b.vec_id AS r, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.pair = b.pair AND a.side = 0 AND b.side = 1),
    p AS (SELECT pair, avg(m) AS precision FROM (SELECT pair, c, max(sim) AS m FROM s GROUP BY ALL) GROUP BY pair),
    q AS (SELECT pair, avg(m) AS recall FROM (SELECT pair, r, max(sim) AS m FROM s GROUP BY ALL) GROUP BY pair)
    SELECT pair, round(precision, 6) AS precision, round(recall, 6) AS recall,
        round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM p JOIN q USING (pair)""",
)
def greedy_match(spark, sf_dir):
    vectors = planted.table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 16).cast("bigint").alias("pair"),
        F.floor(F.col("vec_id") / 8) % 2,
        "embedding",
    ).toDF("pair", "side", "embedding")
    sides = vectors.groupBy("pair").agg(
        F.collect_list(F.when(F.col("side") == 0, F.col("embedding"))).alias("cand"),
        F.collect_list(F.when(F.col("side") == 1, F.col("embedding"))).alias("ref"),
    )
    both = sides.where((F.size("cand") > 0) & (F.size("ref") > 0))
    scored = evaluate.greedy_match(both, "cand", "ref")
    return scored.select("pair", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("greedy_match_tiled", ORACLES["greedy_match"])
def greedy_match_tiled(spark, sf_dir):
    """The same from long rows, in blocks of three vectors."""
    vectors = planted.table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 16").alias("pair"), F.expr("int((vec_id div 8) % 2)").alias("side"), F.expr("vec_id % 8").alias("pos"), F.col("embedding").alias("vector")
    )
    scored = evaluate.greedy_match_tiled(vectors, block=3)
    return scored.select("pair", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def _diverse_sql(k: int) -> str:
    """Pick after pick: the largest worth among the terms that are left."""
    ctes = ["cands AS MATERIALIZED (SELECT vec_id // 40 AS doc_id, vec_id AS term, (vec_id % 7) / 7.0::DOUBLE AS score, embedding::DOUBLE[] AS v FROM embeddings)"]
    ctes.append("picked_0 AS (SELECT doc_id, term, v, 0 AS pick FROM cands WHERE false)")
    for i in range(1, k + 1):
        near = f"coalesce((SELECT max(list_cosine_similarity(c.v, p.v)) FROM picked_{i - 1} p WHERE p.doc_id = c.doc_id), 0.0::DOUBLE)"
        left = f"SELECT c.*, round(0.5::DOUBLE * score - 0.5::DOUBLE * {near}, 9) AS worth FROM cands c WHERE NOT EXISTS (SELECT 1 FROM picked_{i - 1} p WHERE p.doc_id = c.doc_id AND p.term = c.term)"
        best = f"SELECT doc_id, term, v, {i} AS pick FROM ({left}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY worth DESC, term) = 1"
        ctes.append(f"picked_{i} AS MATERIALIZED (SELECT * FROM picked_{i - 1} UNION ALL {best})")
    return f"WITH {', '.join(ctes)} SELECT doc_id, term, pick FROM picked_{k}"


@query("keyword_diverse", _diverse_sql(5))
def keyword_diverse(spark, sf_dir):
    """Five picks of each forty terms, for score and for being unlike the picks before; vectors stand for terms."""
    candidates = planted.table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 40").alias("doc_id"), F.col("vec_id").alias("term"), (F.col("vec_id") % 7 / F.lit(7.0)).alias("score"), F.col("embedding").alias("vector")
    )
    return keywords.diverse(candidates)

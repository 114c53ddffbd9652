import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireworks.functions import centre
from quireworks.functions import text as tx
from quireworks.operators import evaluate, keywords, summarize
from quireworks.staging import stage

WORDS = "model data train loss layer graph token score deep learn small large fast slow wide tall".split()


def make_text(rng, n):
    return " ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 12))).capitalize() + "." for _ in range(n))


def brute_scores(sentences):
    bags = []
    for s in sentences:
        bag = {}
        for t in re.findall(r"\w\w+", s.lower()):
            bag[t] = bag.get(t, 0) + 1
        bags.append(bag)
    n = len(bags)
    df = {}
    for bag in bags:
        for t in bag:
            df[t] = df.get(t, 0) + 1
    vectors = [{t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in bag.items()} for bag in bags]
    centre = {t: sum(v.get(t, 0.0) for v in vectors) / n for t in df}
    size = math.sqrt(sum(x * x for x in centre.values()))
    out = []
    for v in vectors:
        length = math.sqrt(sum(x * x for x in v.values()))
        out.append(sum(x * centre[t] for t, x in v.items()) / (length * size) if length else 0.0)
    return out


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id bigint, section string, text string")


def test_scores_equal_brute_force(spark):
    rng = random.Random(1)
    given = {i: make_text(rng, rng.randint(1, 40)) for i in range(30)}
    rows = summarize.score_sentences(texts(spark, *((i, "all", t) for i, t in given.items()))).collect()
    for i, text in given.items():
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.pos)
        all_sentences = text.replace(". ", ".\n").split("\n")
        good = [s for s in all_sentences if 30 < len(s) < 500 and len(s.split()) >= 5]
        if len(all_sentences) < 3 or not good:
            assert [r.sentence for r in mine] == all_sentences and all(r.score is None for r in mine)
            continue
        assert [r.sentence for r in mine] == good
        assert [r.score for r in mine] == pytest.approx(brute_scores(good), abs=1e-8)
        assert {r.n_cand for r in mine} == {len(good)}


@pytest.mark.parametrize("n, ratio, kept", [(1, 0.3, 3), (10, 0.3, 3), (20, 0.3, 6), (19, 0.3, 5), (10, 0.4, 4), (100, 0.29, 29)])
def test_keep_count(spark, n, ratio, kept):
    df = spark.createDataFrame([(n,)], "n int")
    assert df.select(summarize.keep_count(F.col("n"), ratio).alias("k")).first()["k"] == kept


def test_summary_is_in_source_order_and_from_the_source(spark):
    text = make_text(random.Random(2), 30)
    summary = summarize.extractive_summary(texts(spark, (1, "all", text)), 0.3).first()["summary"]
    picked = summary.replace(". ", ".\n").split("\n")
    places = [text.index(p) for p in picked]
    assert places == sorted(places)


def test_passes_through_below_three_sentences(spark):
    text = "Only one sentence here. And a second one that is longer than thirty characters."
    assert summarize.extractive_summary(texts(spark, (1, "all", text))).first()["summary"] == text


def test_equal_sentences_rank_by_position(spark):
    text = " ".join(["The same sentence comes again and again."] * 8)
    rows = summarize.select_top(summarize.score_sentences(texts(spark, (1, "all", text))), 0.3).collect()
    assert sorted(r.pos for r in rows) == [0, 1, 2]


def section_rows(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id bigint, section string, section_order int, text string")


@pytest.mark.parametrize("n_words, short", [(49, True), (50, False)])
def test_short_section_gate(spark, n_words, short):
    text = "Alpha " * (n_words - 1) + "omega [1]"
    row = summarize.summarize_sections(section_rows(spark, (1, "results", 0, text))).first()
    assert row.is_short is short
    assert row.summary == text[:-4] if short else row.summary == text[:-4] + "."


def test_section_budgets(spark):
    rng = random.Random(4)
    text = make_text(rng, 400)
    rows = summarize.summarize_sections(
        section_rows(spark, (1, "introduction", 0, text), (1, "results", 1, text), (1, "empty", 2, ""))
    ).collect()
    words = {r.section: len(r.summary.split()) for r in rows}
    assert set(words) == {"introduction", "results"}
    assert 180 < words["introduction"] <= 200 and 130 < words["results"] <= 150


def test_best_sentence_stays_when_over_budget(spark):
    long = "Word " * 90 + "end."
    rows = summarize.summarize_sections(section_rows(spark, (1, "results", 0, " ".join([long] * 4)))).collect()
    assert len(rows[0].summary.split()) == 91


def test_roll_up_follows_section_order(spark):
    df = spark.createDataFrame([(1, "b", 1, "second"), (1, "a", 0, "first")], "doc_id int, section string, section_order int, summary string")
    assert summarize.roll_up(df).first()["overall_summary"] == "first second"


@pytest.mark.parametrize("original, summary, expected", [(1000, 250, 75.0), (3, 1, 66.7), (0, 5, None)])
def test_compression(spark, original, summary, expected):
    df = spark.createDataFrame([(original, summary)], "a int, b int")
    assert df.select(summarize.compression_percent(F.col("a"), F.col("b")).alias("c")).first()["c"] == expected


def test_centroid_and_zero_vector(spark):
    df = spark.createDataFrame([(1, "g", [1.0, 0.0]), (2, "g", [0.0, 1.0]), (3, "h", [0.0, 0.0])], "id int, grp string, v array<float>")
    rows = {r.id: r.score for r in summarize.cosine_to_centroid(df, "grp", "v").collect()}
    assert rows[1] == pytest.approx(math.sqrt(0.5)) and rows[3] == 0.0


def test_keywords_equal_brute_force(spark):
    rng = random.Random(6)
    docs = {i: " ".join(rng.choice(WORDS + ["the", "of", "a"]) for _ in range(rng.randint(0, 60))) for i in range(20)}
    df = spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id bigint, text string")
    rows = keywords.top_keywords(df, ["doc_id"], 5).collect()
    bags = {i: [t for t in d.split() if t in WORDS] for i, d in docs.items()}
    dfs = {w: sum(w in b for b in bags.values()) for w in WORDS}
    for i, bag in bags.items():
        scores = {t: round(bag.count(t) * (math.log((1 + len(docs)) / (1 + dfs[t])) + 1), 9) for t in set(bag)}
        best = sorted(scores, key=lambda t: (-scores[t], t))[:5]
        assert [r.term for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r["rank"])] == best


def test_unigram_overlap(spark):
    df = spark.createDataFrame(
        [(1, "the cat sat sat", "the cat sat down"), (2, "", "x y"), (3, "aa bb", "cc dd"), (4, "! !", "cc dd")],
        "id int, c string, r string",
    )
    rows = {r.id: r for r in evaluate.unigram_overlap(df, "id", "c", "r").collect()}
    assert (rows[1].n_overlap, rows[1].precision, rows[1].recall, rows[1].f1) == (3, 0.75, 0.75, 0.75)
    assert 2 not in rows and rows[3].f1 == 0.0
    assert (rows[4].n_candidate, rows[4].precision, rows[4].f1) == (0, 0.0, 0.0)


def test_greedy_match(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 2.0]], [[3.0, 0.0]])], "c array<array<double>>, r array<array<double>>")
    row = evaluate.greedy_match(df, "c", "r").first()
    assert (row.precision, row.recall) == (0.5, 1.0) and row.f1 == pytest.approx(2 / 3)


@pytest.mark.parametrize("f1, band", [(0.95, "excellent"), (0.9, "good"), (0.8, "moderate"), (0.7, "low")])
def test_quality_band(spark, f1, band):
    assert spark.range(1).select(evaluate.quality_band(F.lit(f1)).alias("b")).first()["b"] == band


def test_tokens_cover_all_scripts(spark):
    df = spark.createDataFrame([("Über-naïve x_1 Ж и слово a 12",)], "t string")
    assert df.select(tx.tokens(F.col("t")).alias("t")).first()["t"] == ["über", "naïve", "x_1", "слово", "12"]


def test_hot_terms_take_another_way_and_nothing_changes(spark):
    rows = [(i, " ".join(["common", "shared"] * (i % 3 + 1) + [f"word{i}", f"word{i % 7}"])) for i in range(60)] + [(60, None), (61, "")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    tf = stage(keywords.term_counts(texts, ["doc_id"]), "tf")
    df = {r["term"]: r["df"] for r in tf.groupBy("term").agg(F.count("*").alias("df")).collect()}
    assert {"common", "shared"} <= {r["term"] for r in keywords.hot_terms(tf, 2).collect()}
    for k in (1, 2, 500):
        found = keywords.with_document_frequency(tf, k).collect()
        assert len(found) == tf.count() and all(r["df"] == df[r["term"]] for r in found)
    # a text without words counts in N
    top = {(r["doc_id"], r["term"]): r["score"] for r in keywords.top_keywords(texts, ["doc_id"], 9).collect()}
    assert top[(59, "common")] == round(3 * (math.log(63 / 61) + 1), 9)
    assert keywords.top_keywords(texts.where("doc_id < 0"), ["doc_id"]).count() == 0


def test_diverse_terms_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(d, f"t{i}", round(rng.random(), 3), [rng.random() - 0.3 for _ in range(4)]) for d in range(3) for i in range(9)]
    rows += [(9, "b", 0.5, [1.0, 0.0]), (9, "a", 0.5, [1.0, 0.0]), (9, "zero", 0.1, [0.0, 0.0])]

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    expected = set()
    for d in (0, 1, 2, 9):
        left, picked = sorted(r[1:] for r in rows if r[0] == d), []
        while left and len(picked) < 5:
            worth = [round(0.4 * s - 0.6 * max((cosine(v, p[2]) for p in picked), default=0.0), 9) for _, s, v in left]
            picked.append(left.pop(worth.index(max(worth))))
            expected.add((d, picked[-1][0], len(picked)))
    found = keywords.diverse(spark.createDataFrame(rows, "doc_id long, term string, score double, vector array<double>"), trade=0.6)
    assert {tuple(r) for r in found.collect()} == expected


ODD = (
    "Größe und Straße sind gleich. ΣΑΣ ends here. Ein Satz mit 漢字 und x y z steht auch noch hier! A. b. c. "
    "İstanbul'da başka bir cümle daha var ki uzun olsun. The same words words words come again and again, 0.91 of them. "
    "𝔘nicode letters 𝔘𝔫𝔦 beyond the plane are words as well, and ² or Ⅷ too. [1, 2] See Fig. 3 of a.b@example.com at http://x.y/z now. "
)


def test_sections_are_ranked_in_their_rows_as_sentence_by_sentence(spark, monkeypatch):
    """Scores from Arrow batches and picks inside the row equal the windows over rows of words; no word is a row."""
    rng = random.Random(7)
    given = [(i, rng.choice(["results", "introduction"]), 0, " ".join([make_text(rng, rng.randint(1, 60)), ODD * (i % 3), make_text(rng, 5)])) for i in range(40)]
    given += [(100, "results", 0, "word " * 60), (101, "results", 0, "[1] (2)"), (102, "results", 1, ODD * 3), (102, "introduction", 0, "A b. " * 40), (None, "results", 0, ODD * 2)]
    rows = section_rows(spark, *given)
    keys = ["doc_id", "section", "section_order"]
    cleaned = rows.withColumn("text", tx.clean_text(F.col("text"))).withColumn("is_short", tx.word_count(F.col("text")) < 50)
    scored = summarize.score_sentences(cleaned, keys)
    picked = summarize.within_budget(summarize.select_top(scored, 0.4, keys), summarize.section_budget(F.col("section")), keys)
    expected = summarize.in_source_order(picked, [*keys, "is_short"])
    expected = expected.withColumn("summary", F.when(F.col("is_short"), F.col("summary")).otherwise(tx.clean_summary(F.col("summary"))))
    for size in (centre.SLICE_BYTES, 1):
        monkeypatch.setattr(centre, "SLICE_BYTES", size)
        found = summarize.summarize_sections(rows)
        assert sorted(map(str, found.select(*keys, "is_short", "summary").collect())) == sorted(map(str, expected.collect()))
    assert "posexplode" not in found._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_batch_are_the_tokens(spark):
    lines = [ODD.lower(), "", "a", "é", "éé _ __", "x1 ²² ⅷa 𝔘𝔫", "漢 漢字漢", " ab cd", "ab"]
    data = "".join(lines).encode()
    offsets = [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line.encode()))
    sentence, word, n = centre.words_of(np.frombuffer(data, np.uint8), np.array(offsets))
    tokens = [r["t"] for r in spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, s string").orderBy("i").select(tx.tokens(F.col("s")).alias("t")).collect()]
    assert [list(sentence).count(i) for i in range(len(lines))] == [len(t) for t in tokens]
    flat = [t for ts in tokens for t in ts]
    assert n == len(set(flat)) and [flat.index(t) for t in flat] == [list(word).index(w) for w in word]


@pytest.mark.parametrize("text", [None, "", " ", "a", " a", "a ", "a b", "a  b", "a\tb", "a\nb c", "a b", "a\u0085b\x1cc", "é ö ü", " ", "a 　 b", "x\x0by\rz"])
def test_word_count_whatever_the_spaces(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(tx.word_count(F.col("t")).alias("n"), tx.cleaned_word_count(tx.clean_text(F.col("t"))).alias("m")).first()
    assert got["n"] == got["m"] == len((text or "").split())

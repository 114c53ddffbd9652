import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from check_oracle import rows_of
from quireworks.llm import language, mixing, quality, topk, url_filter
from quireworks.llm.queries import ORACLES, QUERIES

TEXT = {"en": "the quick brown fox and the lazy dog ", "de": "der schnelle braune Fuchs und die Hündin ", "fr": "le renard brun saute où la chienne "}


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {"pipeline", *(f"op{i}" for i in range(1, 14))}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


def test_url_rules_on_edge_cases(spark):
    urls = [None, "no scheme", "http://NET/x", "a://b.example.net/en/1?x#y", "a://example.net", "a://xnet/", "a://example.com/de/", "x://org/fr/a://b", "a://?q", "a://example.net/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[3], urls[3]])], "page_id bigint, url string, rule string")
    rules = [*url_filter.RULES, ("block", "", "/"), ("block", None, "/"), ("block", "b.example.net", None)]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, rules)).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("net", "/x", "net/", "block") and got[3] == ("b.example.net", "/en/1", "example.net/en/", "allow") == got[10] == got[11]
    assert got[4] == ("example.net", "", None, "allow") and got[5][2] is None and got[6][3] == "block" and got[7][2] == "org/fr/" and got[8][:2] == ("", "")
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def test_topk_ties_and_bad_vectors(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan")]), (5, [1.0]), (6, [-1.0, 2.0]), (50, [0.0, 0.0]), (100, [float("inf")])]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    got = [tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 65536), (0, 2, 5, 65536), (50, 1, 0, 0), (50, 2, 1, 0)]
    assert topk.top_k(vectors.limit(0), vectors).count() == 0 and topk.top_k(vectors, vectors.limit(0)).count() == 0


def test_topk_blocks_and_tiles_equal_brute_force(spark, monkeypatch):
    """Many blocks and tiles, ties, repeated ids, sparse terms, shorter vectors, sums for each kind of number."""
    rng = np.random.default_rng(8)
    for name, value in {"BLOCK_ROWS": 60, "TILE_QUERIES": 7, "TILE_ROWS": 16, "LEAST_ROWS": 50}.items():
        monkeypatch.setattr(topk, name, value)
    for scale in (1, 300, 10**6, 2**29):
        v = rng.integers(-scale, scale + 1, (300, 8))
        v[:, ::3] *= rng.random((300, 3)) < 0.05
        rows = [(int(i), x[: 8 - i % 3].tolist()) for i, x in zip(rng.integers(0, 250, 300), v)]
        vectors = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>")
        asked = {}
        for i, x in rows:
            if i % 4 == 0:
                asked[i] = min(asked.get(i, x), x)
        expected = []
        for i, x in asked.items():
            best = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in rows if j != i)[:3]
            expected += [(i, rank, j, -minus) for rank, (minus, j) in enumerate(best, 1)]
        got = topk.top_k(vectors, vectors.where("vec_id % 4 = 0"), 3).collect()
        assert sorted(map(tuple, got)) == sorted(expected)


def test_topk_moves_little_and_scores_in_products(spark):
    """Blocks are packed narrow, and pairs of blocks grow with the square of a table's blocks, not of its thousands of rows."""
    v = np.random.default_rng(9).integers(-200, 200, (20_000, 16))
    assert topk.exact_kind(v, v) is np.float32 and topk.exact_kind(v * 2**12, v * 2**12) is np.float64 and topk.exact_kind(v * 2**22, v * 2**22) is np.int64
    vectors = spark.createDataFrame(pa.table({"vec_id": np.arange(20_000), "v": v.tolist()})).repartition(4)
    blocks, n = topk._blocks(vectors)
    row = blocks.first()
    assert n == 1 and len(row["vectors"]) == 2 * v.size and topk._unpack(*row[1:])[1].tolist() == v.tolist()


def test_language_on_edge_cases(spark):
    rows = [(i, TEXT[lang] * (1 + i % 5), lang) for i, lang in enumerate(["en", "de", "fr"] * 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(docs)
    asked = [(1, None, "x"), (2, "", "x"), (3, "123 !", "x"), (4, TEXT["de"].upper() * 70_000, "x"), (4, "la chienne saute", "x"), (None, "the dog and the fox", None)]
    found = language.identify(spark.createDataFrame(asked, "doc_id bigint, text string, score string"), model).orderBy("doc_id", "lang_pred").collect()
    assert [r["lang_pred"] for r in found] == ["en", "und", "und", "und", "de", "fr"]
    assert all(r["rejected"] and r["score"] == 0 for r in found if r["lang_pred"] == "und") and not found[0]["rejected"]
    none = language.fit(docs.limit(0))
    assert [r["lang_pred"] for r in language.identify(docs.limit(2), none).collect()] == ["und", "und"]
    assert language.identify(docs.limit(0), model).count() == 0


def test_odd_labelled_rows_do_not_switch_rejection_off(spark):
    rows = [(i, TEXT[lang] * (1 + i % 5), lang) for i, lang in enumerate(["en", "de", "fr"] * 100)]
    odd = [(1000, "7 q", "en"), (1001, "привет мир", "de"), (1002, "x", "fr")]
    model = language.fit(spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string"), k=1)
    asked = [(1, "日本語の文章です", "x"), (2, "zzzzzzzzzzzz", "x"), (3, "добрый день", "x"), (4, TEXT["de"], "x"), (5, TEXT["fr"], "x")]
    found = language.identify(spark.createDataFrame(asked, "doc_id bigint, text string, lang string"), model).orderBy("doc_id").collect()
    assert [r["rejected"] for r in found] == [True, True, True, False, False]
    assert len(model.min_score) == 3 and min(model.min_score) > 0.15


def test_languages_of_long_documents_and_many_languages(spark):
    rows = [(i, TEXT["en"] * (1 + i % 5), "en") for i in range(30)] + [(100 + i, TEXT["de"] * (600 + i), "de") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = language.identify(docs.select("doc_id", "text", F.col("lang").alias("own")), language.fit(docs)).collect()
    assert len(found) == 33 and all(r["lang_pred"] == r["own"] and not r["rejected"] for r in found)
    many = [(i, " ".join(chr(97 + i // 9) * 2 + chr(97 + i % 9) * (2 + n) for n in range(5)), f"l{i:02d}") for i in range(70)]
    docs = spark.createDataFrame(many, "doc_id bigint, text string, lang string")
    model = language.fit(docs)
    assert list(model.names) == [lang for _, _, lang in many]
    assert all(r["lang_pred"] == f"l{r['doc_id']:02d}" for r in language.identify(docs.select("doc_id", "text"), model).collect())


def test_language_accuracy_on_held_out(spark, sf_dir):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [r for r in language.op3_language(spark, sf_dir).collect() if r["held_out"]]
    assert rows and sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def test_quality_on_edge_cases(spark):
    good, bad = "a calm and useful sentence about rivers. ", "BUY $$$ now!!! 999 click "
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) * (1 + i % 7)) for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(1, 0), (2, None), (999, 1)], "doc_id bigint, label int")
    model = quality.fit(docs, labels)
    asked = spark.createDataFrame([(1, None), (2, ""), (3, good * 3), (3, bad * 3), (4, "é" * 10)], "doc_id bigint, text string")
    scores = [r["score"] for r in quality.score(asked, model).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    by = {t: s for t, s in zip([r["text"] for r in asked.collect()], scores)}
    assert by[good * 3] > 0.7 > by[bad * 3]
    assert abs(by[None] - by[""]) < 1e-12
    flat = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(asked, flat).collect()} == {0.5} and quality.score(asked.limit(0), model).count() == 0


def test_pairs_in_linear_time_equal_all_pairs():
    import numpy as np

    rng = np.random.default_rng(0)
    column, value = np.array([3, 9, 40]), np.array([0.5, 2.0, -1.0])
    model = quality.Model(0.3, rng.normal(size=quality.WIDTH), rng.normal(size=(quality.WIDTH, 4)), 1.0, 0.0)
    pairs = sum(model.factors[a] @ model.factors[b] * x * y for i, (a, x) in enumerate(zip(column, value)) for b, y in list(zip(column, value))[i + 1 :])
    got = quality.raw_scores(np.zeros(3, np.int64), column, value, 1, model)[0]
    assert abs(got - (0.3 + model.linear[column] @ value + pairs)) < 1e-9


def test_mix_keeps_columns_of_any_name_and_takes_many_weights(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}" if i % 7 else None, "x" * (i % 5), i, i, i, i, i, i) for i in range(60)], "doc_id long, source string, text string, parts int, rate int, cumulated int, copies int, place int, copy_no int")
    weights = {f"s{i}": 1.0 for i in range(2000)} | {"": 2.0, "s1": 0.0}
    mixed = mixing.replicate(docs, weights, epochs=2.0)
    assert sorted(mixed.columns) == sorted(docs.columns)
    rows = mixed.collect()
    assert rows and all(r["parts"] == r["rate"] == r["cumulated"] == r["copies"] == r["place"] == r["doc_id"] for r in rows)
    assert not [r for r in rows if r["source"] == "s1" and r["text"]]
    again = {(r["doc_id"], r["copy_no"]) for r in mixing.replicate(docs.select("doc_id", "source", "text"), weights, epochs=2.0).collect()}
    assert {(r["doc_id"], r["copy_no"]) for r in rows} == again and len(rows) == len(again)


def test_short_texts_are_counted_few_at_a_time():
    texts = pa.array([f"ab{chr(97 + i % 26)}" for i in range(1000)])
    parts = list(language._counted(texts))
    assert max(j - i for i, j, _ in parts) <= language.ROWS_TOGETHER and [i for i, _, _ in parts[1:]] == [j for _, j, _ in parts[:-1]]
    alone = np.concatenate([x for i in range(1000) for _, _, x in language._counted(texts.slice(i, 1))])
    assert np.array_equal(np.concatenate([x for _, _, x in parts]), alone)

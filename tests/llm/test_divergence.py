import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from quireworks.llm import divergence

COLUMNS = "doc_id long, text string, lang string, source string"


def brute(rows, least=10, top=10):
    """(lang, source, part, item, value, rank) of (text, lang, source) in plain Python."""
    words, df, groups = [], Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        words.append((lang, source, found))
        df.update((lang, t) for t in set(found))
        groups.add((lang, source))
    kept = defaultdict(list)
    for (lang, term), n in df.items():
        if n >= least:
            kept[lang].append(term)
    count = Counter()
    for lang, source, found in words:
        for t in found:
            count[lang, source, t] += 1
            count[lang, None, t] += 1

    def shares(lang, source):
        total = sum(count[lang, source, t] for t in kept[lang])
        return {t: 1 + 1_000_000_000 * (count[lang, source, t] + 2) // (total + 2 * len(kept[lang])) for t in kept[lang]}

    def apart(p, q):
        return (p - q) ** 2 // (p + q)

    out = set()
    for lang, source in groups:
        p, q = shares(lang, source), shares(lang, None)
        pairs = [(sum(apart(p[t], o[t]) for t in p), other) for there, other in groups if there == lang and other != source for o in [shares(lang, other)]]
        terms = [(apart(p[t], q[t]), t) for t in p if count[lang, source, t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out |= {(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)}
    return out


def rows_of(df):
    return [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect()]


def planted():
    rows = [("Ab ab cd, xéy 12 Ünd ünd", "en", "a")] * 7 + [("ab zz zz q", "en", "b")] * 6 + [("cd cd Q-q", "en", None)] * 11 + [(None, "en", "empty"), ("", "en", "c")]
    rows += [("nur selten", "de", "a"), ("hier", "de", "b"), ("", None, "x"), (None, None, None), ("eins zwei", "fr", "one")] + [("tie one two", "it", s) for s in "abcd"] * 4
    return rows + [("é ü É " * 3000, "it", "a"), ("\x00\x7f@[`{ \n\t", "it", "b")]


@pytest.mark.parametrize("model_terms,cells", [(500_000, 1_000_000), (2, 5)])
def test_as_by_brute_force(spark, model_terms, cells):
    rows = planted()
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COLUMNS).repartition(5)
    docs = docs.selectExpr("text", "lang", "source", "1 AS term", "2 AS n", "3 AS block", "4 AS model", "5 AS lang_no")
    found = rows_of(divergence.divergence(docs, model_terms=model_terms, cells=cells))
    assert len(found) == len(set(found)) and set(found) == brute(rows)


def test_many_models_give_the_same_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    one = divergence.divergence(docs, least_docs=4)
    assert sorted(rows_of(one)) == sorted(rows_of(divergence.divergence(docs, least_docs=4, model_terms=300, cells=2000)))
    assert set(rows_of(one)) == brute([(r["text"], r["lang"], r["source"]) for r in docs.collect()], least=4)


def test_empty_table_and_no_terms(spark):
    assert divergence.divergence(spark.createDataFrame([], COLUMNS)).count() == 0
    only = spark.createDataFrame([(1, "one", "en", "a"), (2, None, "en", "b")], COLUMNS)
    assert sorted(rows_of(divergence.divergence(only))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_of_huge_counts_are_exact(spark):
    n, total, kept = 9 * 10**14, 10**15, 10**6
    found = spark.range(1).selectExpr(f"{n}L AS n", f"{total}L AS total", f"{kept}L AS kept").selectExpr(divergence._share("n", "total")).first()[0]
    assert found == 1 + 10**9 * (n + 2) // (total + 2 * kept)


@pytest.mark.parametrize("share", [1, 3])
def test_terms_go_to_models_once_a_document(share):
    rows = [("b a a", "x"), ("a b c a a", "x"), ("a " * 70_000, "y"), (None, "y"), ("q", "x")]
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t for t, _ in rows], pa.string()), "lang": pa.array(["l"] * 4 + ["m"]), "source": pa.array([s for _, s in rows])})
    plan = {"l": (0, 0, share), "m": (1, share, 1)}
    out = [r for part in divergence._dealt(plan)([batch]) for r in part.to_pylist()]
    assert sum(len(r["terms"]) for r in out if r["weight"] == 0) == 7  # a and b, a to c, a, q
    assert Counter(t for r in out if r["weight"] == 0 and r["lang_no"] == 0 for t in r["terms"]) == {"a": 3, "b": 2, "c": 1}
    counted = Counter()
    for r in out:
        assert len(set(r["terms"])) == len(r["terms"]) and (r["model"] == share) == (r["lang_no"] == 1)
        counted.update({(r["lang_no"], r["source"], t): r["weight"] for t in r["terms"]})
    assert +counted == {(0, "x", "a"): 5, (0, "x", "b"): 2, (0, "x", "c"): 1, (0, "y", "a"): 70_000, (1, "x", "q"): 1}
    assert sum(len(r["terms"]) for r in out) < 20


def test_terms_are_told_apart_two_megabytes_at_a_time():
    texts = pa.array(["one two Three " * 20_000] * 12)  # 280 kB each
    parts = list(divergence.terms_of(texts))
    assert [(first, len(counts)) for first, counts, _ in parts] == [(0, 7), (7, 5)]
    assert all((counts == 60_000).all() and set(terms.dictionary.to_pylist()) == {"one", "two", "three"} for _, counts, terms in parts)

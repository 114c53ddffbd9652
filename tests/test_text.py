import pytest
from pyspark.sql import functions as F

from quireworks.functions import text as tx
from quireworks.functions.lexicon import ABBREVIATIONS


@pytest.fixture()
def one(spark):
    def value(column_of, text, dtype="string"):
        df = spark.createDataFrame([(text,)], f"t {dtype}")
        return df.select(column_of(F.col("t")).alias("v")).first()["v"]

    return value


@pytest.mark.parametrize(
    "text, expected",
    [
        ("as shown [1, 2] and [3].", "as shown and ."),
        ("in (1, 2) and (2020) but not (a)", "in and but not (a)"),
        ("see https://arxiv.org/abs/1 and http://x.y now", "see and now"),
        ("mail a.b@example.com now", "mail now"),
        ("a lone @ sign, a@ and @b stay", "a lone @ sign, a@ and @b stay"),
        ("See Fig. 3, TABLE 2, eq.4 and figure  5", "See , , and"),
        ("prefig 3 stays", "prefig 3 stays"),
        ("  many \n\t spaces　", "many spaces"),
        ("", ""),
    ],
)
def test_clean_text(one, text, expected):
    assert one(tx.clean_text, text) == expected


def test_clean_text_is_linear_on_unbroken_strings(one):
    assert one(tx.clean_text, "x" * 400_000 + " @ y") == "x" * 400_000 + " @ y"


@pytest.mark.parametrize("text, n", [("", 0), (None, 0), ("a", 1), (" a  b c\n", 3)])
def test_word_count(one, text, n):
    assert one(tx.word_count, text) == n


def test_sentences_keep_numbers_whole(one):
    text = "We reach 0.91 in v1.2. Really?! Yes!  \n Last one"
    assert one(tx.sentences, text) == ["We reach 0.91 in v1.2.", "Really?!", "Yes!", "Last one"]


def test_abbreviations_do_not_end_sentences(one):
    text = "As Smith et al. showed in Fig. 3, it holds. Done."
    assert one(tx.sentences, text) == ["As Smith et al.", "showed in Fig.", "3, it holds.", "Done."]
    assert one(lambda c: tx.sentences(c, ABBREVIATIONS), text) == ["As Smith et al. showed in Fig. 3, it holds.", "Done."]


@pytest.mark.parametrize(
    "length, words, good", [(30, 5, False), (31, 5, True), (499, 5, True), (500, 5, False), (40, 4, False)]
)
def test_quality_gate(one, length, words, good):
    text = "a " * (words - 1)
    text += "b" * (length - len(text))
    assert one(tx.is_quality_sentence, text) is good


@pytest.mark.parametrize(
    "text, expected",
    [
        ("One part. Two parts. tail", "One part. Two parts."),
        ("One part.Two parts. a longer tail here", "One part. Two parts. a longer tail here."),
        ("short", "short."),
        ("", ""),
        ("...", ""),
    ],
)
def test_clean_summary(one, text, expected):
    assert one(tx.clean_summary, text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("https://arxiv.org/abs/2511.12345v1", "2511.12345v1"), ("2401.0001", "2401.0001"), ("none", None)],
)
def test_paper_id(one, text, expected):
    assert one(tx.paper_id, text) == expected


def test_author_line(one):
    assert one(tx.author_line, ["a", "b", "c", "d", "e"], "array<string>") == "a, b, c +2 more"
    assert one(tx.author_line, ["a"], "array<string>") == "a"


def test_labels(one):
    assert one(tx.label_from_key, "related_work") == "Related Work"
    assert one(tx.short_title, "x" * 60) == "x" * 50 + "..."


@pytest.mark.parametrize(
    "date, label",
    [
        ("2024-01-31 12:00:00", "0 day ago"),
        ("2024-01-31 11:00:00", "1 day ago"),
        ("2024-01-29 12:00:00", "2 days ago"),
        ("2024-01-25 11:00:00", "1 week ago"),
        ("2024-01-10 12:00:00", "3 weeks ago"),
        ("2023-12-30 12:00:00", "1 month ago"),
        ("2023-01-30 12:00:00", "1 year ago"),
        ("2021-01-30 12:00:00", "3 years ago"),
    ],
)
def test_age_label(one, date, label):
    as_of = F.lit("2024-01-31 12:00:00").cast("timestamp")
    assert one(lambda c: tx.age_label(c.cast("timestamp"), as_of), date) == label


def test_published_in_both_forms(one):
    long = one(lambda c: tx.published_at(c).cast("string"), "2025-08-07 15:04:07+00:00")
    assert long == "2025-08-07 15:04:07"
    assert one(lambda c: tx.published_at(c).cast("string"), "2025-08-07") == "2025-08-07 00:00:00"
    assert one(lambda c: tx.published_at(c).cast("string"), "soon") is None


def test_contains_takes_wildcards_literally(one):
    assert one(lambda c: tx.contains_ci(c, "50%"), "A 50% gain") is True
    assert one(lambda c: tx.contains_ci(c, "5_%"), "A 50% gain") is False

import random
import statistics

import pytest

from quireworks.operators import layout
from quireworks.sources import schemas

BODY, HEAD = (10.0, "Times"), (12.5, "Times-Bold")


def spans_of(spark, docs):
    """docs: {doc_id: [(page, block_no, block_type, y0, [[(text, size, font), ...], ...]), ...]}"""
    rows = [
        (doc_id, page, block, kind, line_no, span_no, text, size, font, 72.0, float(y0))
        for doc_id, blocks in docs.items()
        for page, block, kind, y0, lines in blocks
        for line_no, line in enumerate(lines)
        for span_no, (text, size, font) in enumerate(line)
    ]
    return spark.createDataFrame(rows, schemas.SPANS)


def simple(*texts):
    """One block per text; texts starting with # are headings."""
    return [
        (i // 50, i, 0, i % 50 * 12, [[(t.lstrip("#"), *(HEAD if t.startswith("#") else BODY))]])
        for i, t in enumerate(texts)
    ]


def sections_of(spark, docs, **options):
    rows = layout.sections(spans_of(spark, docs), **options).orderBy("doc_id", "section_order").collect()
    return {d: [(r.section, r.text) for r in rows if r.doc_id == d] for d in docs}


LONG = "This is a body text that is long enough to count."


def test_median_and_threshold(spark):
    docs = {1: simple("a", "b", "#c", "d"), 2: [(0, 0, 0, 0, [[("x", 9.0, "T"), ("y", 11.0, "T")]])]}
    rows = {r.doc_id: r for r in layout.median_font_size(spans_of(spark, docs)).collect()}
    assert (rows[1].median_size, rows[1].header_size) == (10.0, 10.5)
    assert rows[2].median_size == 10.0


def test_blocks_join_spans_and_lines(spark):
    docs = {1: [(0, 0, 0, 0, [[("Hel", 10.0, "T"), ("lo ", 11.0, "X-BOLD")], [("", 10.0, "T")], [(" world", 10.0, "T")]]),
                (0, 1, 0, 5, [[("  ", 10.0, "T")]]),
                (0, 2, 1, 9, [[("image", 10.0, "T")]])]}
    rows = layout.text_blocks(spans_of(spark, docs)).collect()
    assert [(r.text, r.max_size, r.is_bold) for r in rows] == [("Hello  world", 11.0, True)]


@pytest.mark.parametrize(
    "size, font, length, expected",
    [
        (10.5, "T-Bold", 20, True),
        (10.4, "T-Bold", 20, False),
        (11.5, "T", 20, False),
        (11.6, "T", 20, True),
        (12.5, "T-Bold", 99, True),
        (12.5, "T-Bold", 100, False),
    ],
)
def test_header_flag(spark, size, font, length, expected):
    body = [[("b", 10.0, "T")] for _ in range(5)]
    spans = spans_of(spark, {1: [(0, 0, 0, 0, [[("h" * length, size, font)]]), (0, 1, 0, 20, body)]})
    blocks = layout.blocks_with_sections(spans)
    assert blocks.where("block_no = 0").first()["is_header"] is expected


@pytest.mark.parametrize(
    "title, strict, compat",
    [
        ("Abstract", "abstract", "abstract"),
        ("1 Introduction", "introduction", None),
        ("II. Related Work", "related_work", "related_work"),
        ("3.1 Proposed Method", "methodology", "methodology"),
        ("IV. Methodology", "methodology", "methodology"),
        ("Methodology", "methodology", None),
        ("6 Discussion", "discussion", None),
        ("Conclusion", "conclusion", None),
        ("Experimental Results", "experiments", "experiments"),
        ("Summary", "conclusion", "conclusion"),
        ("Mixed signals", None, None),
        ("Remodelled", None, None),
    ],
)
def test_match_section(spark, title, strict, compat):
    df = spark.createDataFrame([(title,)], "t string")
    both = layout.with_section_match(layout.with_section_match(df, "t", "s"), "t", "c", "compat")
    row = both.first()
    assert (row.s, row.c) == (strict, compat)


def test_sections_reenter_and_drop(spark):
    docs = {
        1: simple(LONG + " 0", "#Results", LONG + " 1", "#Discussion", LONG + " 2", "#Results", LONG + " 3",
                  "#Conclusion", "#References", LONG + " 4"),
    }
    assert sections_of(spark, docs)[1] == [
        ("introduction", LONG + " 0"),
        ("results", f"{LONG} 1 {LONG} 3"),
        ("discussion", LONG + " 2"),
    ]


@pytest.mark.parametrize("length, kept", [(19, False), (20, True)])
def test_short_fragments(spark, length, kept):
    docs = {1: simple("#Results", "x" * length, LONG)}
    assert (("x" * length) in sections_of(spark, docs)[1][0][1]) is kept


@pytest.mark.parametrize("length, boundary", [(79, True), (80, False)])
def test_short_block_with_keyword_opens_a_section(spark, length, boundary):
    text = ("our model " + "y" * 100)[:length]
    docs = {1: simple(text, LONG)}
    assert sections_of(spark, docs)[1][0][0] == ("methodology" if boundary else "introduction")


def test_fallback_takes_longer_blocks_page_by_page(spark):
    docs = {
        1: [(0, 0, 0, 0, [[("Our results section heading", *BODY)]]), (0, 1, 0, 9, [[("short", *BODY)]]),
            (1, 2, 0, 0, [[("Our method section heading", *BODY)]])],
        2: simple("#References", LONG),
        3: simple("#Method"),
    }
    found = sections_of(spark, docs)
    assert found[1] == [("introduction", "Our results section heading\n\nOur method section heading\n")]
    assert found[2] == [("introduction", LONG + "\n")]
    assert found[3] == [("introduction", "")]


def test_reading_order_is_page_then_top_then_left(spark):
    docs = {1: [(1, 0, 0, 0, [[(LONG + " c", *BODY)]]), (0, 1, 0, 50, [[(LONG + " b", *BODY)]]), (0, 2, 0, 10, [[(LONG + " a", *BODY)]])]}
    assert sections_of(spark, docs)[1][0][1] == " ".join(f"{LONG} {x}" for x in "abc")


def test_carry_over_many_pages_equals_a_plain_scan(spark, monkeypatch):
    """Two-level scan over pages with small buckets, against a loop; one document holds most blocks."""
    monkeypatch.setattr(layout, "BUCKET_BITS", 2)
    rng = random.Random(3)
    names = ["Abstract", "Results", "Discussion", "References", "Proposed Method"]
    rows, expected = [], {}
    for doc_id, n in ((1, 900), (2, 40), (3, 1)):
        current = "introduction"
        keys = {"Abstract": "abstract", "Results": "results", "Discussion": "discussion", "References": "references", "Proposed Method": "methodology"}
        for i in range(n):
            heading = rng.random() < 0.02
            text = rng.choice(names) if heading else f"{LONG} {LONG} {i}"
            current = keys[text] if heading else current
            rows.append((doc_id, i // 7, i, 0, 0, 0, text, 12.5 if heading else 10.0, "B" if heading else "T", 72.0, float(i % 7)))
            expected[(doc_id, i)] = (i + 1, current)
    blocks = layout.blocks_with_sections(spark.createDataFrame(rows, schemas.SPANS)).collect()
    assert {(b.doc_id, b.block_no): (b.seq, b.section) for b in blocks} == expected


def test_median_equals_statistics(spark):
    rng = random.Random(5)
    sizes = [rng.choice([8.0, 9.5, 10.0, 12.0]) for _ in range(501)]
    rows = [(1, 0, i, 0, 0, 0, "x", s, "T", 0.0, 0.0) for i, s in enumerate(sizes)]
    assert layout.median_font_size(spark.createDataFrame(rows, schemas.SPANS)).first()["median_size"] == statistics.median(sizes)


def test_html_blocks(spark):
    html = "<h1>Results</h1><p>First <b>part</b> of it<p class='x'>Second\n part</p>tail"
    rows = layout.blocks_from_html(spark.createDataFrame([(1, html)], "page_id bigint, html string")).orderBy("block_no").collect()
    assert [(r.text, r.is_header) for r in rows] == [("Results", True), ("First part of it", False), ("Second part", False)]

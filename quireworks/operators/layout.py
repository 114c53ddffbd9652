"""From page-layout spans to the sections of a paper.

Input ``spans``: one row per text span with doc_id, page, block_no, block_type,
line_no, span_no, text, size, font, x0, y0. A page is the unit of work: blocks are
assembled per (doc_id, page) and written once, bucketed by page. Everything a document
decides about its pages (header size, open sections, places) is computed on one small
row per page, which holds the page's headings and how often each span size occurs on
it. So the spans are read once, texts are put together once, and a document that holds
a large share of all spans is spread over many tasks. What is spread by page or document is
written first, compact, so that its length says over how many tasks.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quireworks.functions import text as tx
from quireworks.functions.lexicon import SECTION_KEYWORDS
from quireworks.functions.skew import buckets_for, salted_join, tasks_for
from quireworks.staging import stage, stage_bucketed

DEFAULT_HEADER_SIZE = 9.0
FIRST_SECTION = "introduction"
BUCKET_BITS = 10  # 1024 pages
#: What a span is read for.
SPAN_COLUMNS = ("doc_id", "page", "block_no", "block_type", "line_no", "span_no", "text", "size", "font", "x0", "y0")
#: Page rows that a running scan over the pages takes in one task.
TASK_PAGES = 200_000


def median_font_size(spans: DataFrame) -> DataFrame:
    """Median span size and header threshold per document.

    ``percentile`` keeps one counter per distinct size and merges map-side, so the
    cost does not depend on how many spans a document has.
    """
    median = F.percentile("size", F.lit(0.5))
    return spans.groupBy("doc_id").agg(
        median.alias("median_size"),
        F.coalesce(median + 0.5, F.lit(DEFAULT_HEADER_SIZE)).alias("header_size"),
    )


def page_blocks(spans: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per block: its lines, largest size, boldness, place, and the ``sizes`` of all its spans.

    Spans join without a gap inside a line. A block without text (an image, blank lines) stays in with
    empty ``text``, since its sizes count for the document. The pages are dealt to ``tasks`` if given.
    """
    is_text = F.col("block_type") == 0

    def of_text(value: Column | str) -> Column:
        return F.when(is_text, F.col(value) if isinstance(value, str) else value)

    lines = (
        spans.where("doc_id is not null and page is not null")
        .repartition(*([tasks] if tasks else []), "doc_id", "page")
        .groupBy("doc_id", "page", "block_no", "line_no")
        .agg(
            tx.ordered_join(F.collect_list(of_text(F.struct("span_no", "text"))), "").alias("line"),
            F.bool_or(is_text).alias("is_text"),
            F.max(of_text("size")).alias("max_size"),
            F.bool_or(F.contains(F.lower(of_text("font")), F.lit("bold"))).alias("is_bold"),
            F.min(of_text("y0")).alias("y0"),
            F.min(of_text("x0")).alias("x0"),
            F.collect_list("size").alias("sizes"),
        )
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.when(F.col("is_text"), F.struct("line_no", "line")))), lambda x: x["line"])
    return lines.groupBy("doc_id", "page", "block_no").agg(
        ordered.alias("lines"),
        F.max("max_size").alias("max_size"),
        F.bool_or("is_bold").alias("is_bold"),
        F.min("y0").alias("y0"),
        F.min("x0").alias("x0"),
        F.flatten(F.collect_list("sizes")).alias("sizes"),
    ).withColumn("text", block_text())


def block_text() -> Column:
    """The trimmed lines of a block, joined with one space."""
    return tx.strip(F.array_join(F.transform("lines", tx.strip), " "))


def text_blocks(spans: DataFrame) -> DataFrame:
    """One row per non-empty text block, see :func:`page_blocks`."""
    return page_blocks(spans).where("text <> ''").drop("sizes")


def in_reading_order(blocks: DataFrame) -> DataFrame:
    """Add ``page_seq``: the place of a block on its page, top to bottom, then left to right; those without text last."""
    by_place = Window.partitionBy("doc_id", "page").orderBy(F.col("text") == "", "y0", "x0", "block_no")
    return blocks.withColumn("page_seq", F.row_number().over(by_place))


def header_flag(max_header_length: int = 100, length: Column | None = None) -> Column:
    """Large, short, and bold or clearly larger than ``header_size``."""
    large = (F.col("max_size") >= F.col("header_size")) & (F.col("is_bold") | (F.col("max_size") > F.col("header_size") + 1))
    return F.coalesce(large & ((F.length("text") if length is None else length) < max_header_length), F.lit(False))


def bare_heading(title: Column, mode: str = "strict") -> Column:
    """A heading in lower case without its numbering.

    ``strict`` strips numbers such as ``3.1`` and roman numerals that end in a dot,
    bracket or space. ``compat`` strips one number level and any leading letters that
    could be roman, so ``introduction`` loses its first letter.
    """
    if mode == "strict":
        numbering = (rf"^\p{{Nd}}+(?:\.\p{{Nd}}+)*\.?{tx.SPACE}*", rf"^[ivxlcdm]+(?:[.)]{tx.SPACE}*|{tx.SPACE}+)")
    elif mode == "compat":
        numbering = (rf"^\p{{Nd}}+\.?{tx.SPACE}*", rf"^[ivxlcdm]+\.?{tx.SPACE}*")
    else:
        raise ValueError(f"unknown mode: {mode}")
    c = tx.strip(F.lower(title))
    for pattern in numbering:
        c = F.regexp_replace(c, pattern, "")
    return tx.strip(c)


def section_of(heading: Column) -> Column:
    """Section that a bare heading names, or null. Keywords match at the start or as whole words.

    Pass a column, not an expression: it is looked at many times. The plain search for a
    keyword spares most headings the pattern.
    """
    tests = []
    for section, keywords in SECTION_KEYWORDS.items():
        words = "|".join(re.escape(k) for k in keywords)
        held = reduce(lambda a, b: a | b, (F.contains(heading, F.lit(k)) for k in keywords))
        tests.append(F.when(held & heading.rlike(rf"(?U)^(?:{words})|\b(?:{words})\b"), section))
    return F.coalesce(*tests)


def with_section_match(df: DataFrame, title: str, out: str, mode: str = "strict", where: Column | None = None) -> DataFrame:
    """Add the section that ``title`` names, where the condition holds."""
    heading = bare_heading(F.col(title), mode)
    heading = heading if where is None else F.when(where, heading)
    return df.withColumn("_heading", heading).withColumn(out, section_of(F.col("_heading"))).drop("_heading")


def page_rows(blocks: DataFrame) -> DataFrame:
    """One small row per page: number of blocks, ``headings`` in order, and the distinct ``sizes`` with their counts.

    A heading is a block with a ``name``; ``always`` says that it opens its section whatever the header size
    is, ``maybe`` that the size decides.
    """
    heading = F.struct("page_seq", "name", "always", "maybe", "max_size", "is_bold")
    counted = "transform(array_distinct(found), s -> struct(s AS size, size(filter(found, x -> x <=> s)) AS n))"
    return (
        blocks.groupBy("doc_id", "page")
        .agg(
            F.count_if(F.col("length") > 0).alias("n_blocks"),
            F.sort_array(F.collect_list(F.when(F.col("name").isNotNull(), heading))).alias("headings"),
            F.flatten(F.collect_list("sizes")).alias("found"),
        )
        .withColumn("sizes", F.expr(counted))
        .drop("found")
    )


def page_header_sizes(pages: DataFrame) -> DataFrame:
    """Add the document's ``header_size``: the counts of all its pages, merged on the way, give the median."""
    each = pages.select("doc_id", F.explode_outer("sizes").alias("s"))
    median = F.percentile("s.size", F.lit(0.5), F.coalesce("s.n", F.lit(0)))
    sizes = each.groupBy("doc_id").agg(F.coalesce(median + 0.5, F.lit(DEFAULT_HEADER_SIZE)).alias("header_size"))
    return salted_join(pages, sizes, ["doc_id"], ["page"])


def page_boundaries(pages: DataFrame) -> DataFrame:
    """(doc_id, page, n_blocks, header_size, boundaries, closing): which headings open a section, and the last of them."""
    large = "h.max_size >= header_size AND (h.is_bold OR h.max_size > header_size + 1)"
    opens = f"filter(headings, h -> h.always OR coalesce(h.maybe AND {large}, false))"
    found = page_header_sizes(pages).withColumn("boundaries", F.expr(f"transform({opens}, h -> struct(h.page_seq AS page_seq, h.name AS section))"))
    return found.select("doc_id", "page", "n_blocks", "header_size", "boundaries", F.try_element_at("boundaries", F.lit(-1))["section"].alias("closing"))


def page_carry(pages: DataFrame) -> DataFrame:
    """Per (doc_id, page): blocks before the page and the section open at its start.

    A running scan over written pages (doc_id, page, n_blocks, closing) in two levels, pages within a bucket of
    pages and buckets within a document, so no task walks through all pages of a huge document.
    Both levels read the same shuffled page rows.
    """
    def before(*keys: str, by: str) -> WindowSpec:
        return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)

    pages = (
        pages.select("doc_id", "page", "n_blocks", "closing")
        .withColumn("bucket", F.coalesce(F.shiftright("page", BUCKET_BITS), F.lit(0)))
        .repartition(max(1, -(-pages.count() // TASK_PAGES)), "doc_id", "bucket")
    )
    over_buckets = before("doc_id", by="bucket")
    buckets = (
        pages.groupBy("doc_id", "bucket")
        .agg(F.sum("n_blocks").alias("n_blocks"), F.max_by("closing", F.when(F.col("closing").isNotNull(), F.col("page"))).alias("closing"))
        .select(
            "doc_id",
            "bucket",
            F.coalesce(F.sum("n_blocks").over(over_buckets), F.lit(0)).alias("bucket_offset"),
            F.last("closing", ignorenulls=True).over(over_buckets).alias("bucket_open"),
        )
    )
    over_pages = before("doc_id", "bucket", by="page")
    return (
        pages.select(
            "doc_id",
            "bucket",
            "page",
            F.coalesce(F.sum("n_blocks").over(over_pages), F.lit(0)).alias("page_offset"),
            F.last("closing", ignorenulls=True).over(over_pages).alias("page_open"),
        )
        .join(buckets, ["doc_id", "bucket"])
        .select(
            "doc_id",
            "page",
            (F.col("bucket_offset") + F.col("page_offset")).alias("page_offset"),
            F.coalesce("page_open", "bucket_open", F.lit(FIRST_SECTION)).alias("open_section"),
        )
    )


def carry_sections(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Add to written ``blocks`` what their ``pages`` (:func:`page_boundaries`) say.

    ``seq`` is the place in the document, ``boundary`` the section that a block opens, ``section`` the last
    one opened at or before it. Blocks do not move: the page rows come to them. Sent to all tasks instead, as
    few page rows would be, they would make Spark read the blocks out of their buckets and move them later.
    """
    plan = pages.select("doc_id", "page", "header_size", "boundaries").join(page_carry(pages), ["doc_id", "page"])
    opened = F.array_max(F.filter("boundaries", lambda b: b["page_seq"] <= F.col("page_seq")))
    return (
        blocks.where("length > 0").join(plan.hint("merge"), ["doc_id", "page"])
        .withColumn("opened", opened)
        .withColumn("boundary", F.when(F.col("opened.page_seq") == F.col("page_seq"), F.col("opened.section")))
        .withColumn("section", F.coalesce("opened.section", "open_section"))
        .withColumn("seq", F.col("page_offset") + F.col("page_seq"))
        .drop("opened", "page_offset", "open_section", "boundaries", "name", "always", "maybe", "length")
    )


def _staged(blocks: DataFrame, mode: str, always: Column, maybe: Column, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Blocks (spread by page over ``tasks``, in reading order) with their headings matched, and their page rows, both written."""
    blocks = blocks.withColumns({"always": always, "maybe": maybe, "length": F.length("text")}).drop("text")
    blocks = blocks.withColumn("text", block_text())  # for the match only; the lines are kept
    blocks = with_section_match(blocks, "text", "name", mode, (F.col("length") > 0) & (F.col("always") | F.col("maybe"))).drop("text")
    blocks = stage_bucketed(blocks, "blocks", "doc_id", "page", buckets=tasks)
    # the page rows are read twice, for the header sizes and beside them
    return blocks.withColumn("text", block_text()), stage(page_boundaries(stage(page_rows(blocks), "page-rows")), "pages")


def blocks_with_sections(
    spans: DataFrame, mode: str = "strict", short_header_len: int = 80, max_header_length: int = 100, tasks: int | None = None
) -> DataFrame:
    """All text blocks of all documents with reading order, header flag, boundary and section.

    Spans and blocks are written to the shared folder when this is called; the length of the spans says over how
    many tasks the pages are spread. Spans that are written already need not be once more if ``tasks`` is given.
    """
    if tasks is None:
        spans = stage(spans.select(*SPAN_COLUMNS).repartition("doc_id", "page"), "spans")  # a page's spans in one file
        tasks = buckets_for(spans)
    length = F.length("text")
    blocks, pages = _staged(in_reading_order(page_blocks(spans, tasks)), mode, length < short_header_len, length < max_header_length, tasks)
    return carry_sections(blocks, pages).withColumn("is_header", header_flag(max_header_length)).drop("sizes")


def is_content(min_length: int = 20) -> Column:
    """Blocks that belong to a section: no boundary, no short fragment, not in the references."""
    return F.col("boundary").isNull() & (F.length("text") >= min_length) & (F.col("section") != "references")


def section_blocks(blocks: DataFrame, min_length: int = 20) -> DataFrame:
    """The content in long form, one row per block, for texts too large for one value per section."""
    return blocks.where(is_content(min_length)).select("doc_id", "section", "page", "page_seq", "seq", "text")


def _page_pieces(blocks: DataFrame, min_length: int) -> DataFrame:
    """(doc_id, page, group, place, text): the content of a page by section, and under ``group`` '' all that is none.

    Blocks are joined where they already lie together. Of what is no content only longer blocks are kept, each
    with its lines and a line break; a document without any section consists of these.
    """
    content = is_content(min_length)
    raw = tx.strip(F.array_join("lines", "\n"))
    leftover = F.when(F.length(raw) > min_length, F.concat(raw, F.lit("\n"))).otherwise(F.lit(""))
    place = F.struct("page", "page_seq")
    return (
        blocks.select(
            "doc_id",
            "page",
            place.alias("place"),
            F.when(content, F.col("section")).otherwise(F.lit("")).alias("group"),
            F.when(content, F.col("text")).otherwise(leftover).alias("text"),
        )
        .groupBy("doc_id", "page", "group")
        .agg(F.collect_list(F.struct("place", "text")).alias("items"), F.min("place").alias("place"))
        .select("doc_id", "page", "group", "place", F.when(F.col("group") != "", tx.ordered_join(F.col("items"), " ")).otherwise(tx.ordered_join(F.col("items"), "")).alias("text"))
    )


def document_sections(blocks: DataFrame, min_length: int = 20) -> DataFrame:
    """One row per document: ``sections``, an array of (section, text) in order of first content.

    Re-entered sections are appended. A document without any section gets all its longer
    blocks, page by page, as introduction. Its blocks are exactly those that are no content,
    so they travel along as one more group and no second pass is needed.
    Blocks are joined per page first, where they already lie together; the shuffle by document
    then moves one piece per page and section, to as many tasks as the length of the blocks, read
    when this is called, asks for. For documents too large for one row see :func:`section_pieces`.
    """
    joined = F.when(F.col("group") != "", tx.ordered_join(F.col("items"), " ")).otherwise(tx.ordered_join(F.col("items"), "\n"))
    whole = (
        _page_pieces(blocks, min_length)
        .repartition(tasks_for(blocks), "doc_id")
        .groupBy("doc_id", "group")
        .agg(
            F.collect_list(F.when((F.col("group") != "") | (F.col("text") != ""), F.struct("place", "text"))).alias("items"),
            F.min("place").alias("place"),
        )
        .select("doc_id", "group", "place", joined.alias("text"))
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("place", F.col("group").alias("section"), "text"))).alias("all"))
    )
    found = F.filter("all", lambda s: s["section"] != "")
    fallback = F.transform("all", lambda s: F.struct(F.lit(FIRST_SECTION).alias("section"), s["text"].alias("text")))
    named = F.transform(found, lambda s: F.struct(s["section"].alias("section"), s["text"].alias("text")))
    return whole.select("doc_id", F.when(F.size(found) > 0, named).otherwise(fallback).alias("sections"))


SEAM = 50  # characters, as long as the longest entity


def section_pieces(blocks: DataFrame, min_length: int = 20) -> DataFrame:
    """(doc_id, section, page, first, place, text, glue): the sections of :func:`document_sections` in pieces, written.

    A piece is what a page holds of a section, so no document and no section is ever one row. The text of a
    section is its pieces in the order of ``place``, that of a document its pieces in the order of ``first``
    and ``place``, with ``glue`` in between.
    """
    pieces = stage(_page_pieces(blocks, min_length).where("text <> ''"), "page-pieces")
    firsts = pieces.groupBy("doc_id", "group").agg(F.min("place").alias("first"))
    kinds = pieces.groupBy("doc_id").agg(F.bool_or(F.col("group") != "").alias("has_sections"))
    kept = firsts.join(kinds, "doc_id").where((F.col("group") != "") == F.col("has_sections")).drop("has_sections")
    found = salted_join(pieces, kept, ["doc_id", "group"], ["page"])
    section = F.when(F.col("group") != "", F.col("group")).otherwise(F.lit(FIRST_SECTION))
    glue = F.when(F.col("group") != "", F.lit(" ")).otherwise(F.lit("\n"))
    return stage(found.select("doc_id", section.alias("section"), "page", "first", "place", "text", glue.alias("glue")), "section-pieces")


def with_seams(pieces: DataFrame, width: int = SEAM, near: int = 3) -> DataFrame:
    """Add ``before`` and ``after``, the characters around each piece in its document, ``width`` of them.

    They come from the ``near`` pieces on either side, which are long enough, as each holds a block. Only the
    ends of pieces are put in order; the texts stay spread.
    """
    order = Window.partitionBy("doc_id").orderBy("first", "place")
    ends = pieces.select("doc_id", "section", "page", "first", "place", "glue", F.left("text", F.lit(width)).alias("head"), F.right("text", F.lit(width)).alias("tail"))
    glued = "array_join(filter(array({}), x -> x IS NOT NULL), glue)"
    columns = {f"tail_{i}": F.lag("tail", i).over(order) for i in range(1, near + 1)} | {f"head_{i}": F.lead("head", i).over(order) for i in range(1, near + 1)}
    ends = ends.withColumns(columns).select(
        "doc_id", "section", "page",
        F.right(F.expr(glued.format(", ".join(f"tail_{i}" for i in range(near, 0, -1)))), F.lit(width)).alias("before"),
        F.left(F.expr(glued.format(", ".join(f"head_{i}" for i in range(1, near + 1)))), F.lit(width)).alias("after"),
    )
    return pieces.join(ends, ["doc_id", "section", "page"])


def with_full_text(documents: DataFrame) -> DataFrame:
    """Add ``sections_found`` (ordered names) and ``full_text`` to :func:`document_sections`."""
    return documents.withColumns(
        {
            "sections_found": F.transform("sections", lambda s: s["section"]),
            "full_text": F.array_join(F.transform("sections", lambda s: s["text"]), " "),
        }
    )


def section_rows(documents: DataFrame) -> DataFrame:
    """Long form of :func:`document_sections`: (doc_id, section, section_order, text)."""
    # outer, then filtered: an inner explode would make Spark build the array once more to test it
    return (
        documents.select("doc_id", F.posexplode_outer("sections").alias("section_order", "s"))
        .where("s is not null")
        .select("doc_id", F.col("s.section").alias("section"), "section_order", F.col("s.text").alias("text"))
    )


def sections(spans: DataFrame, mode: str = "strict", short_header_len: int = 80) -> DataFrame:
    """(doc_id, section, section_order, text) of every document, fallback included."""
    return section_rows(document_sections(blocks_with_sections(spans, mode, short_header_len)))


def sections_of_blocks(blocks: DataFrame, mode: str = "strict", short_header_len: int = 80) -> DataFrame:
    """Sections of ready-made blocks that carry ``is_header`` (plain text lines, web pages)."""
    unknown = {"max_size": F.lit(None).cast("double"), "is_bold": F.lit(False), "sizes": F.array().cast("array<double>")}
    blocks = stage(blocks, "ready-blocks")
    tasks = buckets_for(blocks)
    ordered = in_reading_order(blocks.withColumns(unknown).repartition(tasks, "doc_id", "page"))
    opens = F.col("is_header") | (F.length("text") < short_header_len)
    return section_rows(document_sections(carry_sections(*_staged(ordered, mode, opens, F.lit(False), tasks))))


LINES_PER_PAGE = 60


def blocks_from_lines(documents: DataFrame) -> DataFrame:
    """Plain-text documents as blocks: every non-empty line is one block of normal size."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "line"))
    return lines.select(
        "doc_id",
        F.floor(F.col("block_no") / LINES_PER_PAGE).cast("int").alias("page"),
        "block_no",
        F.col("block_no").cast("double").alias("y0"),
        F.lit(0.0).alias("x0"),
        F.array("line").alias("lines"),
        tx.strip(F.col("line")).alias("text"),
        F.lit(False).alias("is_header"),
    ).where("text <> ''")


def blocks_from_html(pages: DataFrame) -> DataFrame:
    """Web pages as blocks: headings h1 to h6 and paragraphs; a heading tag sets the header flag.

    A block runs from its start tag to the next end or start tag of this kind.
    """
    marked = F.regexp_replace("html", r"(?i)<(h[1-6]|p)(\s[^>]*)?>", "\u0002$1\u0003")
    marked = F.regexp_replace(marked, r"(?i)</(h[1-6]|p)\s*>", "\u0004")
    found = pages.select(
        F.col("page_id").alias("doc_id"), F.posexplode(F.split(marked, "\u0002")).alias("block_no", "piece")
    ).where("block_no > 0")
    body = F.split(F.split_part("piece", F.lit("\u0003"), F.lit(2)), "\u0004")[0]
    body = tx.strip(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", " "), f"{tx.SPACE}+", " "))
    return found.select(
        "doc_id",
        F.lit(0).alias("page"),
        "block_no",
        F.col("block_no").cast("double").alias("y0"),
        F.lit(0.0).alias("x0"),
        F.array(body).alias("lines"),
        body.alias("text"),
        F.startswith(F.lower("piece"), F.lit("h")).alias("is_header"),
    ).where("text <> ''")

"""Column functions on text. All of them stay inside Spark's own expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that separates words: ASCII, and what counts as such elsewhere.
_ASCII_SPACES = "\t\n\x0b\f\r "
_OTHER_SPACES = "".join(
    chr(c)
    for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
# Texts of nothing but such characters, ASCII and the letters of Europe among them, hold none of the other spaces.
_NO_OTHER_SPACES = r"^[ -~\t-\r\x{a1}-\x{167f}\x{2010}-\x{2027}]*\z"
SPACE_CHARS = _ASCII_SPACES + _OTHER_SPACES
SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# A word token: two or more letters, digits or underscores of any script.
TOKEN = r"[a-z\p{L}\p{N}_]{2,}"

# What text cleaning removes, in order of application. White space is plain by then.
CITATIONS = r"\[\p{Nd}+(?:,\s*\p{Nd}+)*\]"
PAREN_NUMBERS = r"\(\p{Nd}+(?:,\s*\p{Nd}+)*\)"
URLS = r"http[s]?://\S+"
# A whole word with an inner @. The look-behind lets a match start only where a word
# starts, which keeps the scan linear on very long unbroken strings.
EMAILS = r"(?<!\S)\S[^\s@]*+@\S+"
# The look-ahead turns most positions away before the costlier test for a word border.
FIGURE_REFS = r"(?=[fteFTE])(?iU)\b(fig|figure|table|eq)\.?\s*\p{Nd}+"

# Fixed value: the form of a paper's identifier.
PAPER_ID = r"(\d{4}\.\d{4,5}(v\d+)?)"

_BREAK = "\u0001"
_MASKED_DOT = "\u0002"


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def plain_spaces(c: Column) -> Column:
    """Every kind of white space beyond ASCII as an ordinary space.

    A plain class like ``\\s`` is several times faster to match than one that lists them all. Most texts hold
    no other white space, which costs less to see than to replace.
    """
    return F.when(c.rlike(_NO_OTHER_SPACES), c).otherwise(F.translate(c, _OTHER_SPACES, " " * len(_OTHER_SPACES)))


def _bound(c: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` of a value that is worked out once, however often the step looks at it."""
    return F.get(F.transform(F.array(c), step), F.lit(0))


def clean_text(c: Column) -> Column:
    """Drop citations, numbers in brackets, links, addresses and figure references; tidy spaces."""
    # each runs only on texts that hold what it cannot match without
    def without(pattern: str, piece: str) -> Callable[[Column], Column]:
        return lambda t: F.when(F.contains(t, F.lit(piece)), F.regexp_replace(t, pattern, "")).otherwise(t)

    for pattern, piece in ((CITATIONS, "["), (PAREN_NUMBERS, "("), (URLS, "http"), (EMAILS, "@")):
        c = _bound(plain_spaces(c) if pattern == CITATIONS else c, without(pattern, piece))
    return F.trim(F.regexp_replace(F.regexp_replace(c, FIGURE_REFS, ""), r"\s+", " "))


def word_count(c: Column) -> Column:
    """Number of words separated by white space; 0 for null. Where words lie one space apart, it is the spaces that are counted."""
    def count(t: Column) -> Column:
        ends = F.startswith(t, F.lit(" ")) | F.endswith(t, F.lit(" "))
        apart = reduce(lambda a, b: a | b, (F.contains(t, F.lit(s)) for s in ("  ", "\n", "\t", "\x0b", "\f", "\r")), ends)
        return F.when(apart, F.regexp_count(t, F.lit(r"\S+"))).otherwise(cleaned_word_count(t))

    return F.coalesce(_bound(plain_spaces(c), count), F.lit(0))


def cleaned_word_count(c: Column) -> Column:
    """As :func:`word_count` for a text of :func:`clean_text`, or a piece of it, whose words lie one space apart."""
    return F.when(c != "", F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit(""))) + 1).otherwise(F.lit(0))


def tokens(c: Column) -> Column:
    """Lower-cased word tokens in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def sentences(c: Column, abbreviations: Sequence[str] = ()) -> Column:
    """Array of trimmed, non-empty sentences.

    A sentence ends at a run of . ! ? followed by white space, so ``0.91`` and
    ``v1.2`` stay whole. ``abbreviations`` (without their last dot) do not end one.
    """
    if abbreviations:
        names = "|".join(re.escape(a) for a in sorted(abbreviations, key=len, reverse=True))
        c = F.regexp_replace(c, rf"(?U)\b({names})\.(?={SPACE})", "$1" + _MASKED_DOT)
    parts = F.split(F.regexp_replace(c, rf"([.!?]+){SPACE}+", "$1" + _BREAK), _BREAK)
    if abbreviations:
        parts = F.transform(parts, lambda s: F.replace(s, F.lit(_MASKED_DOT), F.lit(".")))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def is_quality_sentence(s: Column) -> Column:
    """Between 31 and 499 characters and at least five words."""
    return F.length(s).between(31, 499) & (word_count(s) >= 5)


def clean_summary(c: Column) -> Column:
    """Drop a short trailing piece, tidy the gaps between sentences and close with a full stop."""
    pieces = F.split(c, r"\.")
    last_is_short = F.length(strip(F.element_at(pieces, -1))) < 10
    kept = F.when(
        (F.size(pieces) > 1) & last_is_short, F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    ).otherwise(pieces)
    joined = F.array_join(F.filter(F.transform(kept, strip), lambda p: p != ""), ". ")
    return F.when((joined != "") & ~F.endswith(joined, F.lit(".")), F.concat(joined, F.lit("."))).otherwise(joined)


def paper_id(c: Column) -> Column:
    """The ``2511.12345v1`` style identifier inside a text or link; null if there is none."""
    return F.nullif(F.regexp_extract(c, PAPER_ID, 1), F.lit(""))


def last_path_part(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def author_line(authors: Column, shown: int = 3) -> Column:
    """First authors, then how many more there are."""
    rest = F.size(authors) - shown
    return F.concat(
        F.array_join(F.slice(authors, 1, shown), ", "),
        F.when(rest > 0, F.concat(F.lit(" +"), rest.cast("string"), F.lit(" more"))).otherwise(F.lit("")),
    )


def label_from_key(c: Column) -> Column:
    """``related_work`` -> ``Related Work``."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def short_title(c: Column, width: int = 50) -> Column:
    return F.concat(F.substring(c, 1, width), F.lit("..."))


def age_label(ts: Column, as_of: Column) -> Column:
    """``3 days ago`` style label relative to a given moment; part days count as whole ones."""
    micros = F.abs(F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp")))
    days = F.ceil(micros / F.lit(86_400_000_000)).cast("int")

    def label(n: Column, unit: str) -> Column:
        plural = F.when(n > 1, F.lit("s")).otherwise(F.lit(""))
        return F.concat(n.cast("string"), F.lit(f" {unit}"), plural, F.lit(" ago"))

    return (
        F.when(days < 7, label(days, "day"))
        .when(days < 30, label(F.floor(days / 7), "week"))
        .when(days < 365, label(F.floor(days / 30), "month"))
        .otherwise(label(F.floor(days / 365), "year"))
    )


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "MMM yyyy")


def published_at(c: Column) -> Column:
    """Timestamp from ``2025-08-07 15:04:07+00:00`` or ``2025-08-07``; null otherwise."""
    return F.try_to_timestamp(c)


def contains_ci(c: Column, phrase: str) -> Column:
    """Case-insensitive containment; ``%`` and ``_`` in the phrase are ordinary characters."""
    return F.contains(F.lower(c), F.lit(phrase.lower()))


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` occurs in ``text`` without overlap (as a substring)."""
    # in bytes, which need no counting; every occurrence has the same
    return (
        (F.octet_length(text) - F.octet_length(F.replace(text, part, F.lit("")))) / F.octet_length(part)
    ).cast("bigint")


def ordered_join(items: Column, sep: str) -> Column:
    """Join the last field of collected ``struct(order..., text)`` items in their order."""
    return F.array_join(F.transform(F.sort_array(items), lambda x: x["text"]), sep)

"""Personal data: candidate spans judged by boosted trees, with Spark expressions only.

Base rules find e-mail addresses, IP numbers, payment cards and telephone numbers by pattern and check
(octets, Luhn, number of digits); what they find always counts. On top, generators with looser patterns
propose spans that may overlap them: written-out e-mail addresses, longer dotted numbers, cards with
other separators, telephone numbers without a plus. Each candidate has a few small features of its format
and context. Boosted trees of depth two score it, and a threshold per kind, calibrated so that at least
``PRECISION`` of the candidates of all documents above it are base spans, selects what is added.

The trees are fitted on the candidates of all documents: positive are those that the base rules have too, and
the base spans once more as the base rules cannot see them: addresses written out, cards with dots, telephone
numbers without the plus, each in its own context. So the trees learn which formats and contexts surround
personal data, not the base rules; number tables, versions and dates are what is negative. The features have
few values, so everything is counted by feature vector in one pass of Spark (at most some thousand rows), and
the boosting itself is arithmetic over that table on the driver.

Positions come from splitting: the lengths of what lies between the matches and of the matches, added up
by a scan in blocks, so a text with many matches stays near-linear. Patterns are possessive or
anchored, so long runs of letters or digits cost linear time and no stack. Offsets are code points.

Cases: a null text counts as empty; no match gives counts of 0, an empty ``spans`` and the hash of the
empty string; repeated rows are judged each; an empty table gives an empty result; ``find_spans`` leaves out
columns of ``docs`` that are named like its own (they begin with ``pii_``), ``redact`` gives all columns back,
whatever their names. Equal spans of a base rule and a generator are one span. ``redact`` replaces
overlapping spans together, by the label of the first.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import table

KINDS = ("email", "ip", "card", "phone")
# The base rules. (?:(?<!x)|\G) keeps a search from starting anew inside a run that failed.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3,}+",
    "card": r"[0-9](?:[\x20./-]?[0-9])++",
    "phone": r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9])++",
}
#: What a text must hold for a match; cheaper than the patterns themselves, which it must not narrow.
_BASE_HINT = {
    "email": r"@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "phone": r"\+[0-9]",
}
_LOOSE_HINT = {
    "email": r"[@)\]]",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[\x20./-]?[0-9]){12}",
    "phone": r"[0-9](?:[\x20().-]{0,2}[0-9]){6}",
}
_CUES = {
    "email": r"mail|contact|write|reach|address",
    "ip": r"\bip\b|host|server|address|from|login",
    "card": r"card|visa|master|amex|pay|credit|debit",
    "phone": r"call|phone|tel|mobile|fax|contact|reach",
}
PRECISION = 0.9
TREES, RATE, CONTEXT, BLOCK = 12, 0.4, 24, 256
#: Feature names with their number of values.
FEATURES = {"kind": 4, "digits": 5, "marks": 5, "joined_before": 2, "joined_after": 2, "cue": 2, "valid": 2, "mixed": 2, "written": 2}


@dataclass(frozen=True)
class Trees:
    """(feature, cut, feature below, cut, feature above, cut, four leaf values) per tree; thresholds by kind."""

    start: float
    trees: tuple[tuple, ...]
    thresholds: tuple[float, ...]


def exclusive_scan(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each item of an array of long, the merge of 0 and the items before it."""
    zero, size = F.lit(0).cast("bigint"), F.size(values)
    blocks = F.when(size > 0, F.sequence(F.lit(0), ((size - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))

    def block(i: Column) -> Column:
        return F.slice(values, i * BLOCK + 1, F.lit(BLOCK))

    def grow(items: Column, start: Column) -> Column:
        return F.aggregate(items, F.array(start), lambda acc, v: F.concat(acc, F.array(merge(F.element_at(acc, -1), v))))

    heads = grow(F.transform(blocks, lambda i: F.aggregate(block(i), zero, merge)), zero)
    paired = F.slice(F.arrays_zip(blocks.alias("i"), heads.alias("head")), F.lit(1), F.size(blocks))
    return F.flatten(F.transform(paired, lambda z: F.slice(grow(block(z["i"]), z["head"]), F.lit(1), F.size(block(z["i"])))))


def _luhn(value: Column) -> Column:
    backward = F.reverse(F.regexp_replace(value, r"[^0-9]", ""))
    digits = F.transform(F.sequence(F.lit(1), F.length(backward)), lambda i: F.ascii(F.substr(backward, i, F.lit(1))) - 48)
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"[^0-9]", ""))


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return value.rlike(r"\.\p{Alpha}{2,}$")
    if kind == "ip":
        return _octets(value)
    if kind == "card":
        return F.when(_digits(value).between(13, 19), _luhn(value)).otherwise(F.lit(False))
    return _digits(value).between(9, 15)


def _octets(value: Column) -> Column:
    def small(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(short) <= 3, F.coalesce(short.try_cast("int"), F.lit(0)) <= 255).otherwise(F.lit(False))

    return F.forall(F.split(value, r"\."), small)


def _found(docs: DataFrame, patterns: dict[str, str], hints: dict[str, str], prefix: str) -> DataFrame:
    """For each kind, ``<prefix><kind>``: the matches as (start, value, before, after), in order."""
    text = F.coalesce("text", F.lit(""))
    columns = {}
    for kind, pattern in patterns.items():
        hinted = text.rlike(hints[kind])
        columns[f"{prefix}m_{kind}"] = F.when(hinted, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        columns[f"{prefix}g_{kind}"] = F.when(hinted, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
    docs = docs.withColumns(columns)
    lengths = {}
    for kind in patterns:
        both = F.arrays_zip(F.col(f"{prefix}m_{kind}").alias("m"), F.slice(f"{prefix}g_{kind}", F.lit(1), F.size(f"{prefix}m_{kind}")).alias("g"))
        lengths[f"{prefix}l_{kind}"] = F.transform(both, lambda z: (F.length(z["g"]) + F.length(z["m"])).cast("bigint"))
    docs = docs.withColumns(lengths)
    found = {}
    for kind in patterns:
        m, g = F.col(f"{prefix}m_{kind}"), F.col(f"{prefix}g_{kind}")
        start = exclusive_scan(F.col(f"{prefix}l_{kind}"), lambda a, b: a + b)
        rows = F.arrays_zip(m.alias("value"), F.slice(g, F.lit(1), F.size(m)).alias("before"), start.alias("at"), F.slice(g, 2, F.greatest(F.size(m), F.lit(0))).alias("after"))
        found[f"{prefix}{kind}"] = F.transform(
            rows,
            lambda r: F.struct(
                (r["at"] + F.length(r["before"])).alias("start"), r["value"].alias("value"), F.right(r["before"], F.lit(CONTEXT)).alias("before"), F.left(r["after"], F.lit(1)).alias("after")
            ),
        )
    helpers = [f"{prefix}{x}_{k}" for k in patterns for x in "mgl"]
    return docs.withColumns(found).drop(*helpers)


def _code(kind: Column | int, start: Column, length: Column) -> Column:
    """Kind, start and length as one long that sorts by kind and start."""
    kind = F.lit(kind) if isinstance(kind, int) else kind
    return kind.cast("bigint") * (1 << 60) + start.cast("bigint") * (1 << 30) + length.cast("bigint")


def _base_spans(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``pii_b_<kind>``: codes of the spans of the base rules; with ``whole`` also ``pii_w_<kind>``, the spans themselves."""
    docs = _found(docs, BASE, _BASE_HINT, "pii_b_")
    for i, kind in enumerate(KINDS):
        kept = F.col(f"pii_b_{kind}")
        if kind != "email":
            kept = F.filter(kept, lambda s: _valid(kind, s["value"]))
        if whole:
            docs = docs.withColumn(f"pii_w_{kind}", kept)
            kept = F.col(f"pii_w_{kind}")
        docs = docs.withColumn(f"pii_b_{kind}", F.transform(kept, lambda s: _code(i, s["start"], F.length(s["value"]))))
    return docs


def _judged(kind: str) -> Callable[[Column], Column]:
    """What makes (code, features) of a candidate of this kind."""

    def judged(s: Column) -> Column:
        digits, marks = _digits(s["value"]), F.length(F.regexp_replace(s["value"], r"[A-Za-z0-9]", ""))
        return F.struct(
            _code(KINDS.index(kind), s["start"], F.length(s["value"])).alias("code"),
            F.lit(KINDS.index(kind)).alias("kind"),
            F.when(digits == 0, 0).when(digits < 9, 1).when(digits < 13, 2).when(digits < 20, 3).otherwise(4).alias("digits"),
            F.least(marks, F.lit(4)).alias("marks"),
            s["before"].rlike(r"[\p{L}\p{N}]$").cast("int").alias("joined_before"),
            s["after"].rlike(r"^[\p{L}\p{N}]").cast("int").alias("joined_after"),
            F.lower(s["before"]).rlike(_CUES[kind]).cast("int").alias("cue"),
            _valid(kind, s["value"]).cast("int").alias("valid"),
            (_separators(s["value"]) > 1).cast("int").alias("mixed") if kind == "card" else F.lit(0).alias("mixed"),
            (~F.contains(s["value"], F.lit("@"))).cast("int").alias("written") if kind == "email" else F.lit(0).alias("written"),
        )

    return judged


def _separators(value: Column) -> Column:
    """How many different characters stand between the digits."""
    return F.size(F.array_distinct(F.filter(F.split(F.regexp_replace(value, r"[0-9]", ""), ""), lambda c: c != "")))


def _disguised(kind: str) -> Callable[[Column], Column]:
    """What a base span becomes so that only a generator finds it; null if it has no such form."""

    def changed(s: Column) -> Column:
        value = s["value"]
        if kind == "email":
            value = F.regexp_replace(F.regexp_replace(value, "@", " (at) "), r"\.", " (dot) ")
        elif kind == "card":
            value = F.regexp_replace(value, r"[\x20-]", ".")
        elif kind == "phone":
            value = F.regexp_replace(value, r"^\+", "")
        return F.when(value != s["value"], F.struct(s["start"].alias("start"), value.alias("value"), s["before"].alias("before"), s["after"].alias("after")))

    return changed


def _candidates(docs: DataFrame) -> DataFrame:
    """``pii_candidates``: (code, features) of what the generators propose."""
    docs = _found(docs, LOOSE, _LOOSE_HINT, "pii_c_")
    sets = []
    for kind in KINDS:
        kept = F.col(f"pii_c_{kind}")
        if kind in ("card", "phone"):
            low, high = (13, 19) if kind == "card" else (9, 15)
            kept = F.filter(kept, lambda s: _digits(s["value"]).between(low, high))
        sets.append(F.transform(kept, _judged(kind)))
    return docs.withColumn("pii_candidates", F.concat(*sets)).drop(*(f"pii_c_{k}" for k in KINDS))


def _gain(rows: list[tuple[dict, float, float]], feature: str, cut: int) -> float:
    """Reduction of squared error of (residual, weight) rows by the split ``feature <= cut``."""
    out = 0.0
    for side in (True, False):
        part = [(g, h) for f, g, h in rows if (f[feature] <= cut) == side]
        g, h = sum(p[0] for p in part), sum(p[1] for p in part)
        out += g * g / (h + 1.0)
    return out


def _split(rows: list[tuple[dict, float, float]]) -> tuple[str, int]:
    cuts = [(f, c) for f, n in FEATURES.items() for c in range(n - 1)]
    return max(cuts, key=lambda fc: _gain(rows, *fc))


def boost(table_rows: list[tuple[dict, int, int]]) -> Trees:
    """Trees from (features, candidates, positives) rows, by Newton steps on log loss, and thresholds."""
    total, positive = sum(r[1] for r in table_rows), sum(r[2] for r in table_rows)
    if not positive:
        return Trees(-20.0, (), (math.inf,) * len(KINDS))
    share = min(max(positive / total, 1e-3), 1 - 1e-3)
    start = math.log(share / (1 - share))
    scores, trees = [start] * len(table_rows), []

    def leaf(rows: list) -> float:
        return RATE * sum(r[1] for r in rows) / (sum(r[2] for r in rows) + 1.0)

    for _ in range(TREES):
        rows = []
        for (features, n, good), score in zip(table_rows, scores):
            p = 1 / (1 + math.exp(-score))
            rows.append((features, good - n * p, n * p * (1 - p)))
        first = _split(rows)
        sides = [[r for r in rows if (r[0][first[0]] <= first[1]) == side] for side in (True, False)]
        tree = [*first]
        for side in sides:
            feature, cut = _split(side)
            tree += [feature, cut, leaf([r for r in side if r[0][feature] <= cut]), leaf([r for r in side if r[0][feature] > cut])]
        trees.append(tuple(tree))
        scores = [s + _tree_value(tree, f) for s, (f, _, _) in zip(scores, table_rows)]
    thresholds = []
    for kind in range(len(KINDS)):
        ranked = sorted(((s, n, good) for s, (f, n, good) in zip(scores, table_rows) if f["kind"] == kind), reverse=True)
        best, n, good = math.inf, 0, 0
        for at, (score, more, right) in enumerate(ranked):
            n, good = n + more, good + right
            last = at + 1 == len(ranked) or ranked[at + 1][0] < score
            if last and good >= PRECISION * n and good:
                best = score
        thresholds.append(best)
    return Trees(start, tuple(trees), tuple(thresholds))


def _tree_value(tree: tuple | list, features: dict) -> float:
    f0, c0, f1, c1, a, b, f2, c2, c, d = tree
    if features[f0] <= c0:
        return a if features[f1] <= c1 else b
    return c if features[f2] <= c2 else d


def fit(docs: DataFrame) -> Trees:
    """Trees and thresholds from all of ``docs`` (text)."""
    marked = _candidates(_base_spans(docs.select("text"), whole=True))
    known = F.array_union(F.array_union("pii_b_email", "pii_b_ip"), F.array_union("pii_b_card", "pii_b_phone"))
    marked = marked.withColumn("pii_known", known)

    def labelled(c: Column, good: Column) -> Column:
        return F.struct(*(c[f].alias(f) for f in FEATURES), good.alias("good"))

    rows = [F.transform("pii_candidates", lambda c: labelled(c, F.array_contains("pii_known", c["code"])))]
    for kind in ("email", "card", "phone"):
        hidden = F.filter(F.transform(f"pii_w_{kind}", _disguised(kind)), lambda s: s.isNotNull())
        rows.append(F.transform(F.transform(hidden, _judged(kind)), lambda c: labelled(c, F.lit(True))))
    # outer, then filtered: an inner explode would make Spark work out all candidates once more to see whether there are any
    each = marked.select(F.explode_outer(F.concat(*rows)).alias("c")).where("c IS NOT NULL")
    counted = each.groupBy(*(F.col(f"c.{f}").alias(f) for f in FEATURES)).agg(F.count(F.lit(1)).alias("n"), F.count_if("c.good").alias("good"))
    return boost([({f: r[f] for f in FEATURES}, r["n"], r["good"]) for r in counted.orderBy(*FEATURES).collect()])


def _selected(model: Trees) -> Column:
    """Codes of the candidates whose score reaches the threshold of their kind."""

    def score(c: Column) -> Column:
        total = F.lit(model.start)
        for f0, c0, f1, c1, a, b, f2, c2, x, y in model.trees:
            low = F.when(c[f1] <= c1, F.lit(a)).otherwise(F.lit(b))
            high = F.when(c[f2] <= c2, F.lit(x)).otherwise(F.lit(y))
            total = total + F.when(c[f0] <= c0, low).otherwise(high)
        return total

    def enough(c: Column) -> Column:
        needed = F.lit(math.inf)
        for i, t in enumerate(model.thresholds):
            needed = F.when(c["kind"] == i, F.lit(t - 1e-9)).otherwise(needed)
        return score(c) >= needed

    if all(math.isinf(t) for t in model.thresholds):
        return F.array().cast("array<bigint>")
    return F.transform(F.filter("pii_candidates", enough), lambda c: c["code"])


def find_spans(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with ``pii_b_<kind>`` (codes of base spans) and ``pii_spans`` (codes of all spans, sorted)."""
    docs = docs.drop(*(c for c in docs.columns if c.startswith("pii_")))
    marked = _candidates(_base_spans(docs)).withColumn("pii_added", _selected(model)).drop("pii_candidates")
    together = F.concat(*(F.col(f"pii_b_{k}") for k in KINDS), F.col("pii_added"))
    return marked.withColumn("pii_spans", F.sort_array(F.array_distinct(together))).drop("pii_added")


def _parts(code: Column) -> tuple[Column, Column, Column]:
    kind = F.shiftright(code, 60)
    start = F.shiftright(code, 30).bitwiseAND(F.lit((1 << 30) - 1))
    return kind, start, start + code.bitwiseAND(F.lit((1 << 30) - 1))


def _kind_name(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), kind.cast("int") + 1)


def _written(codes: Column) -> Column:
    def one(code: Column) -> Column:
        kind, start, end = _parts(code)
        return F.concat_ws(":", _kind_name(kind), start.cast("string"), end.cast("string"))

    return F.array_join(F.transform(codes, one), ",")


def summarise(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans); the counts are of base spans."""
    counts = [F.size(f"pii_b_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS]
    base = F.concat(*(F.col(f"pii_b_{k}") for k in KINDS))
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("pii_spans")).alias("spans"))


def redact(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with spans in ``text`` replaced by ``<EMAIL>`` and so on; a null text stays null."""
    names = docs.columns
    docs = docs.toDF(*(f"kept {i}" if c.startswith("pii_") else c for i, c in enumerate(names)))
    columns = docs.columns
    found = find_spans(docs, model)
    by_place = F.array_sort(
        F.transform("pii_spans", lambda c: F.struct(_parts(c)[1].alias("start"), (-_parts(c)[2]).alias("back"), _parts(c)[0].alias("kind")))
    )
    found = found.withColumn("pii_at", by_place)
    found = found.withColumn("pii_ends", F.transform("pii_at", lambda s: -s["back"]))
    reach = exclusive_scan(F.col("pii_ends"), lambda a, b: F.greatest(a, b))
    found = found.withColumn("pii_at", F.arrays_zip(F.col("pii_at").alias("s"), reach.alias("reach"), F.col("pii_ends").alias("stop")))
    text = F.col("text")

    def piece(z: Column) -> Column:
        label = F.concat(F.lit("<"), F.upper(_kind_name(z["s"]["kind"])), F.lit(">"))
        fresh = F.concat(F.substr(text, (z["reach"] + 1).cast("int"), (z["s"]["start"] - z["reach"]).cast("int")), label)
        return F.when((z["s"]["start"] >= z["reach"]), fresh).otherwise(F.lit(""))

    last = F.array_max("pii_ends")
    tail = F.substr(text, (last + 1).cast("int"), F.length(text))
    redacted = F.when(F.size("pii_spans") > 0, F.concat(F.array_join(F.transform("pii_at", piece), ""), tail)).otherwise(text)
    return found.withColumn("text", redacted).select(*(F.col(f"`{c}`") for c in columns)).toDF(*names)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return summarise(find_spans(docs, fit(docs)))

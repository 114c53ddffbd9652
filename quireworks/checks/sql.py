"""The SQL side of the checks: named building blocks that queries put together."""

from __future__ import annotations

from quireworks.checks.planted import HEADINGS, PLANTED
from quireworks.functions.lexicon import (
    ENTITY_PATTERNS,
    ENTITY_TYPES,
    SECTION_KEYWORDS,
    STEP_INDICATORS,
    STEP_VERBS,
    STOP_WORDS,
)

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACES = "||".join(
    f"chr({c})"
    for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {_SPACES})"


def ascii_words(x: str) -> str:
    """Letters beyond ASCII as ``z`` and other such characters as a space, for ASCII word borders."""
    return rf"regexp_replace(regexp_replace({x}, '[^\x00-\x7F\p{{L}}\p{{N}}]', ' ', 'g'), '[^\x00-\x7F]', 'z', 'g')"


def word_count(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{WS}]+'))"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def sentences(x: str) -> str:
    pieces = rf"string_split(regexp_replace({x}, '([.!?]+)[{WS}]+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({pieces}, lambda s: {strip('s')}), lambda s: s <> '')"


def clean_text(x: str) -> str:
    for pattern, flags in (
        (rf"\[\p{{Nd}}+(?:,[{WS}]*\p{{Nd}}+)*\]", "g"),
        (rf"\(\p{{Nd}}+(?:,[{WS}]*\p{{Nd}}+)*\)", "g"),
        (rf"http[s]?://[^{WS}]+", "g"),
        (rf"[^{WS}]+@[^{WS}]+", "g"),
        (rf"\b(fig|figure|table|eq)\.?[{WS}]*\p{{Nd}}+", "gi"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '', '{flags}')"
    return strip(f"regexp_replace({x}, '[{WS}]+', ' ', 'g')")


def clean_summary(x: str) -> str:
    pieces = f"string_split({x}, '.')"
    kept = (
        f"CASE WHEN len({pieces}) > 1 AND length({strip(f'{pieces}[-1]')}) < 10 "
        f"THEN {pieces}[1:-2] ELSE {pieces} END"
    )
    joined = f"array_to_string(list_filter(list_transform({kept}, lambda p: {strip('p')}), lambda p: p <> ''), '. ')"
    return f"CASE WHEN {joined} <> '' AND right({joined}, 1) <> '.' THEN {joined} || '.' ELSE {joined} END"


_PLANTED = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {quoted(p)}" for i, p in enumerate(PLANTED)) + " END"
_HEADING = "CASE (n // 4) % 9 " + " ".join(f"WHEN {i} THEN {quoted(h)}" for i, h in enumerate(HEADINGS)) + " END"
_STOP = ", ".join(quoted(w) for w in STOP_WORDS)


def _match(title: str, mode: str) -> str:
    if mode == "strict":
        first, second = rf"^\p{{Nd}}+(?:\.\p{{Nd}}+)*\.?[{WS}]*", rf"^[ivxlcdm]+(?:[.)][{WS}]*|[{WS}]+)"
    else:
        first, second = rf"^\p{{Nd}}+\.?[{WS}]*", rf"^[ivxlcdm]+\.?[{WS}]*"
    bare = strip(f"regexp_replace(regexp_replace({strip(ascii_words(f'lower({title})'))}, '{first}', ''), '{second}', '')")
    cases = []
    for section, keywords in SECTION_KEYWORDS.items():
        tests = [f"starts_with(b, {quoted(k)}) OR regexp_matches(b, {quoted(chr(92) + 'b' + k + chr(92) + 'b')})" for k in keywords]
        cases.append(f"WHEN {' OR '.join(tests)} THEN {quoted(section)}")
    return f"list_transform([{bare}], lambda b: CASE {' '.join(cases)} END)[1]"


def match_section(title: str, mode: str = "strict") -> str:
    return _match(title, mode)


def _blocks(mode: str) -> str:
    return f"""
    SELECT *, CASE WHEN is_header OR length(text) < 80 THEN {_match('text', mode)} END AS boundary
    FROM headed"""


def _carried(source: str) -> str:
    return f"""
    SELECT *, coalesce(last_value(boundary IGNORE NULLS) OVER (
        PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'introduction') AS section
    FROM {source}"""


def _sections(source: str) -> str:
    return f"""
    SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id ORDER BY first_seq) - 1 AS section_order, text
    FROM (
        SELECT doc_id, section, min(seq) AS first_seq, string_agg(text, ' ' ORDER BY seq) AS text
        FROM {source}
        WHERE boundary IS NULL AND length(text) >= 20 AND section <> 'references'
        GROUP BY doc_id, section
    )
    UNION ALL
    SELECT doc_id, 'introduction', 0, coalesce(string_agg(page_text, chr(10) ORDER BY page) FILTER (page_text <> ''), '')
    FROM (
        SELECT doc_id, page, coalesce(string_agg(raw || chr(10), '' ORDER BY seq) FILTER (length(raw) > 20), '') AS page_text
        FROM {source}
        WHERE doc_id NOT IN (
            SELECT doc_id FROM {source} WHERE boundary IS NULL AND length(text) >= 20 AND section <> 'references')
        GROUP BY doc_id, page
    )
    GROUP BY doc_id"""


_ENTITY_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, {quoted(kind)} AS type, {i} AS pattern_no, unnest(regexp_extract_all(t, {quoted(pattern)})) AS raw FROM plain"
    for i, (kind, pattern, _) in enumerate(ENTITY_PATTERNS)
)

# Every block names what it reads; ``build`` adds what is needed, in order.
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    "planted_text": ((), f"SELECT doc_id, text || ' ' || {_PLANTED} AS text FROM documents"),
    "planted_first": ((), f"SELECT doc_id, {_PLANTED} || ' ' || text AS text FROM documents"),
    "lines": (
        (),
        "SELECT doc_id, n - 1 AS n, line FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, n)",
    ),
    "shaped": (
        ("lines",),
        f"""SELECT doc_id, n, n % 4 = 0 AS is_heading,
            CASE WHEN n % 4 = 0 THEN {_HEADING} WHEN n % 4 = 1 THEN line || ' ' || {_PLANTED.replace("CASE doc_id % 6", "CASE (doc_id + n) % 6")} ELSE line END AS line FROM lines""",
    ),
    "spans": (
        ("shaped",),
        """
    SELECT doc_id, n * 12 // 720 AS page, 2 * (n // 4) + CASE WHEN is_heading THEN 0 ELSE 1 END AS block_no,
        n AS line_no, span_no,
        CASE span_no WHEN 0 THEN substr(line, 1, length(line) // 2) ELSE substr(line, length(line) // 2 + 1) END AS text,
        CASE WHEN is_heading THEN 12.5::DOUBLE ELSE 10.0::DOUBLE + (doc_id % 3) * 0.5::DOUBLE END AS size,
        CASE WHEN is_heading THEN 'Times-Bold' ELSE 'Times-Roman' END AS font,
        72.0::DOUBLE AS x0, (n * 12 % 720)::DOUBLE AS y0
    FROM shaped, (VALUES (0), (1)) AS v(span_no)""",
    ),
    "medians": (("spans",), "SELECT doc_id, median(size) AS median_size, coalesce(median(size) + 0.5, 9.0) AS header_size FROM spans GROUP BY doc_id"),
    "span_lines": (
        ("spans",),
        """
    SELECT doc_id, page, block_no, line_no, string_agg(text, '' ORDER BY span_no) AS line, max(size) AS size,
        bool_or(contains(lower(font), 'bold')) AS bold, min(y0) AS y0, min(x0) AS x0
    FROM spans GROUP BY doc_id, page, block_no, line_no""",
    ),
    "blocks": (
        ("span_lines",),
        f"""
    SELECT * FROM (
        SELECT doc_id, page, block_no, {strip(f"string_agg({strip('line')}, ' ' ORDER BY line_no)")} AS text,
            {strip("string_agg(line, chr(10) ORDER BY line_no)")} AS raw,
            max(size) AS max_size, bool_or(bold) AS is_bold, min(y0) AS y0, min(x0) AS x0
        FROM span_lines GROUP BY doc_id, page, block_no
    ) WHERE text <> ''""",
    ),
    "headed": (
        ("blocks", "medians"),
        """
    SELECT b.*, m.header_size, row_number() OVER (PARTITION BY b.doc_id ORDER BY page, y0, x0, block_no) AS seq,
        max_size >= header_size AND length(text) < 100 AND (is_bold OR max_size > header_size + 1) AS is_header
    FROM blocks b JOIN medians m USING (doc_id)""",
    ),
    "bounded": (("headed",), _blocks("strict")),
    "bounded_compat": (("headed",), _blocks("compat")),
    "carried": (("bounded",), _carried("bounded")),
    "carried_compat": (("bounded_compat",), _carried("bounded_compat")),
    "sections": (("carried",), _sections("carried")),
    "sections_compat": (("carried_compat",), _sections("carried_compat")),
    "line_blocks": (
        ("lines",),
        f"""
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS seq, text AS raw, CASE WHEN length(text) < 80 THEN {_match('text', 'strict')} END AS boundary
    FROM (SELECT doc_id, n, n // 60 AS page, {strip('line')} AS text FROM lines) WHERE text <> ''""",
    ),
    "line_carried": (("line_blocks",), _carried("line_blocks")),
    "line_sections": (("line_carried",), _sections("line_carried")),
    "html_pieces": (
        (),
        r"""
    SELECT page_id AS doc_id, n - 1 AS n, piece FROM pages, unnest(string_split(
        regexp_replace(regexp_replace(html, '(?i)<(h[1-6]|p)(\s[^>]*)?>', chr(2) || '\1' || chr(3), 'g'),
        '(?i)</(h[1-6]|p)\s*>', chr(4), 'g'), chr(2))) WITH ORDINALITY AS u(piece, n)
    WHERE n > 1""",
    ),
    "html_blocks": (
        ("html_pieces",),
        f"""
    SELECT *, text AS raw, n AS seq, 0 AS page, CASE WHEN is_header OR length(text) < 80 THEN {_match('text', 'strict')} END AS boundary
    FROM (
        SELECT doc_id, n, lower(piece[1]) = 'h' AS is_header,
            {strip(f"regexp_replace(regexp_replace(split_part(split_part(piece, chr(3), 2), chr(4), 1), '<[^>]*>', ' ', 'g'), '[{WS}]+', ' ', 'g')")} AS text
        FROM html_pieces
    ) WHERE text <> ''""",
    ),
    "html_carried": (("html_blocks",), _carried("html_blocks")),
    "html_sections": (("html_carried",), _sections("html_carried")),
    "doc_texts": (
        ("sections",),
        """
    SELECT doc_id, string_agg(text, ' ' ORDER BY section_order) AS full_text,
        string_agg(section, ',' ORDER BY section_order) AS sections_found, count(*) AS n_sections
    FROM sections GROUP BY doc_id""",
    ),
    # --- entities over a relation entity_input(doc_id, text)
    "plain": (("entity_input",), f"SELECT doc_id, {ascii_words('text')} AS t FROM entity_input"),
    "mentions": (("plain",), f"SELECT doc_id, type, {strip('raw')} AS entity FROM ({_ENTITY_MATCHES})"),
    "entity_ranks": (
        ("mentions", "entity_input"),
        r"""
    SELECT doc_id, type, entity, freq, row_number() OVER (PARTITION BY doc_id, type ORDER BY freq DESC, entity) AS rank
    FROM (
        SELECT m.doc_id, type, entity, (length(text) - length(replace(text, entity, ''))) // length(entity) AS freq
        FROM (SELECT DISTINCT doc_id, type, entity FROM mentions) m JOIN entity_input d ON m.doc_id = d.doc_id
        WHERE length(entity) BETWEEN 2 AND 50 AND regexp_matches(entity, '\p{L}')
            AND len(regexp_extract_all(entity, '[[:punct:]]')) / length(entity) <= 0.3
    ) QUALIFY rank <= 15""",
    ),
    "entity_types": ((), "SELECT * FROM (VALUES " + ", ".join(f"({quoted(t)})" for t in ENTITY_TYPES) + ") AS v(type)"),
    # --- ranking over a relation texts(doc_id, section, section_order, text)
    "text_sentences": (
        ("texts",),
        f"""
    SELECT doc_id, section, section_order, pos - 1 AS pos, sentence, {word_count('sentence')} AS words
    FROM texts, unnest({sentences('text')}) WITH ORDINALITY AS u(sentence, pos)""",
    ),
    "candidates": (
        ("text_sentences",),
        """
    SELECT *, count(*) OVER g AS n_cand FROM (
        SELECT *, n_all >= 3 AND n_good > 0 AS ranked FROM (
            SELECT *, length(sentence) BETWEEN 31 AND 499 AND words >= 5 AS good, count(*) OVER g AS n_all,
                count(*) FILTER (length(sentence) BETWEEN 31 AND 499 AND words >= 5) OVER g AS n_good
            FROM text_sentences WINDOW g AS (PARTITION BY doc_id, section)
        )
    ) WHERE NOT ranked OR good WINDOW g AS (PARTITION BY doc_id, section)""",
    ),
    "sentence_terms": (
        ("candidates",),
        f"""
    SELECT doc_id, section, pos, n_cand, term, count(*) AS tf
    FROM (SELECT doc_id, section, pos, n_cand, unnest({tokens('sentence')}) AS term FROM candidates WHERE ranked)
    GROUP BY ALL""",
    ),
    "sentence_weights": (
        ("sentence_terms",),
        """
    SELECT *, sum(w) OVER (PARTITION BY doc_id, section, term) / n_cand AS centre FROM (
        SELECT *, tf * (ln((1.0::DOUBLE + n_cand) / (1.0::DOUBLE + count(*) OVER (PARTITION BY doc_id, section, term))) + 1.0::DOUBLE) AS w
        FROM sentence_terms)""",
    ),
    "centre_lengths": (
        ("sentence_weights",),
        """
    SELECT doc_id, section, sum(c * c) AS centre_sq
    FROM (SELECT DISTINCT ON (doc_id, section, term) doc_id, section, term, centre AS c FROM sentence_weights)
    GROUP BY doc_id, section""",
    ),
    "sentence_scores": (
        ("candidates", "sentence_weights", "centre_lengths"),
        """
    SELECT c.*, CASE WHEN ranked THEN round(coalesce(dot / sqrt(sq * centre_sq), 0.0), 9) END AS score
    FROM candidates c
    LEFT JOIN (SELECT doc_id, section, pos, sum(w * centre) AS dot, sum(w * w) AS sq FROM sentence_weights GROUP BY ALL) s
        ON c.doc_id = s.doc_id AND c.section = s.section AND c.pos = s.pos
    LEFT JOIN centre_lengths l ON c.doc_id = l.doc_id AND c.section = l.section""",
    ),
    "sentence_ranks": (
        ("sentence_scores",),
        "SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY score DESC NULLS LAST, pos) AS rank FROM sentence_scores",
    ),
    "top_sentences": (
        ("sentence_ranks",),
        "SELECT * FROM sentence_ranks WHERE NOT ranked OR rank <= greatest(3, n_cand * 4 // 10)",
    ),
    "budgeted": (
        ("top_sentences",),
        """
    SELECT * FROM (
        SELECT *, sum(words) OVER (PARTITION BY doc_id, section ORDER BY rank ROWS UNBOUNDED PRECEDING) AS total FROM top_sentences
    ) WHERE rank = 1 OR total <= CASE WHEN section IN ('introduction', 'conclusion') THEN 200 ELSE 150 END""",
    ),
    # --- section summaries: texts = long cleaned sections
    "cleaned": (("sections",), f"SELECT doc_id, section, section_order, {clean_text('text')} AS text FROM sections WHERE text <> ''"),
    "long_sections": (("cleaned",), f"SELECT * FROM cleaned WHERE {word_count('text')} >= 50"),
    "section_summaries": (
        ("budgeted", "cleaned"),
        f"""
    SELECT doc_id, section, section_order, {clean_summary('s')} AS summary, false AS is_short
    FROM (SELECT doc_id, section, section_order, string_agg(sentence, ' ' ORDER BY pos) AS s FROM budgeted GROUP BY ALL)
    UNION ALL
    SELECT doc_id, section, section_order, text, true FROM cleaned WHERE {word_count('text')} < 50""",
    ),
    "overall": (
        ("section_summaries",),
        "SELECT doc_id, string_agg(summary, ' ' ORDER BY section_order) AS overall_summary FROM section_summaries GROUP BY doc_id",
    ),
    # --- keywords over a relation keyword_input(doc_id, section, text)
    "term_counts": (
        ("keyword_input",),
        f"""
    SELECT doc_id, section, term, count(*) AS tf
    FROM (SELECT doc_id, section, unnest({tokens('text')}) AS term FROM keyword_input)
    WHERE term NOT IN ({_STOP}) GROUP BY ALL""",
    ),
    "keyword_ranks": (
        ("term_counts", "keyword_input"),
        """
    SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY score DESC, term) AS rank FROM (
        SELECT doc_id, section, term,
            round(tf * (ln(((SELECT count(*) FROM keyword_input) + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1.0::DOUBLE), 9) AS score
        FROM term_counts JOIN (SELECT term, count(*) AS df FROM term_counts GROUP BY term) USING (term)
    )""",
    ),
    # --- steps over a relation method(doc_id, text)
    "step_list": (
        ("method",),
        f"""
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS step_no, step FROM (
        SELECT doc_id, pos, step, row_number() OVER (PARTITION BY doc_id, lower(step) ORDER BY pos) AS nth FROM (
            SELECT doc_id, pos, CASE WHEN right(s, 1) = '.' THEN s ELSE s || '...' END AS step
            FROM method, unnest({sentences('text')}) WITH ORDINALITY AS u(s, pos)
            WHERE length(s) BETWEEN 31 AND 199
                AND ({' OR '.join(f"contains(lower(s), {quoted(w)})" for w in STEP_INDICATORS + STEP_VERBS)})
                AND length(text) >= 100 AND len({sentences('text')}) >= 3
        )
    ) WHERE nth = 1""",
    ),
    "steps": (("step_list",), "SELECT * FROM step_list QUALIFY count(*) OVER (PARTITION BY doc_id) >= 2"),
    "flow_edges": (
        ("steps",),
        """
    SELECT doc_id, step_no - 1 AS edge_no, CASE step_no WHEN 1 THEN 'Start' ELSE 'S' || (step_no - 1) END AS source, 'S' || step_no AS target
    FROM steps
    UNION ALL
    SELECT doc_id, max(step_no), 'S' || max(step_no), 'End' FROM steps GROUP BY doc_id""",
    ),
    "charts": (
        ("steps", "flow_edges"),
        """
    SELECT n.doc_id, 'graph TD' || chr(10) || '    Start([Start])' || chr(10) || nodes || '    End([End])' || chr(10) || arrows AS chart
    FROM (SELECT doc_id, string_agg('    S' || step_no || '["' || replace(replace(step, '"', ''''), chr(10), ' ') || '"]' || chr(10), '' ORDER BY step_no) AS nodes
          FROM steps GROUP BY doc_id) n
    JOIN (SELECT doc_id, string_agg('    ' || source || ' --> ' || target || chr(10), '' ORDER BY edge_no) AS arrows
          FROM flow_edges GROUP BY doc_id) e ON n.doc_id = e.doc_id""",
    ),
    # --- tables under the names of the application
    "users": (
        (),
        """SELECT c_custkey AS id, c_name AS email, c_name AS full_name, c_mktsegment AS bio FROM customer
        UNION ALL SELECT -s_suppkey, s_name, s_name, NULL FROM supplier""",
    ),
    "summaries": (
        (),
        """
    SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS paper_title, o_orderstatus AS arxiv_id,
        o_totalprice::DECIMAL(10,2) AS processing_time_seconds, o_orderdate AS created_at, word_count
    FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity::BIGINT)::BIGINT AS word_count FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    ),
    "activity": ((), "SELECT event_id AS id, user_id, CASE WHEN event_id % 9 <> 0 THEN event_type END AS activity_type, ts AS created_at, props FROM events"),
    "papers": (
        (),
        """
    SELECT p_partkey AS id, p_name AS title, string_split(p_name, ' ') AS authors, p_brand AS summary, p_type AS primary_category,
        p_retailprice AS published FROM part""",
    ),
    "user_stats": (
        ("users", "summaries"),
        """
    SELECT u.id AS user_id, u.email, count(s.id) AS total_summaries,
        round(sum(s.processing_time_seconds)::DOUBLE / count(s.processing_time_seconds), 6) AS avg_processing_time,
        sum(s.word_count)::BIGINT AS total_words_processed, max(s.created_at) AS last_summary_date,
        count(DISTINCT s.created_at::DATE) AS active_days
    FROM users u LEFT JOIN summaries s ON u.id = s.user_id GROUP BY u.id, u.email""",
    ),
    "latest": (
        ("activity",),
        "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS recency FROM activity QUALIFY recency <= 10",
    ),
}


def build(final: str, *needs: str, **local: str) -> str:
    """``WITH`` all needed blocks, then ``final``. ``local`` adds or replaces blocks by name."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        if name in local:
            for other in BLOCKS:
                if f" {other}" in f" {local[name]} " and other != name and _mentions(local[name], other):
                    visit(other)
        else:
            for other in BLOCKS[name][0]:
                visit(other)
        order.append(name)

    for name in needs:
        visit(name)
    bodies = [f"{name} AS MATERIALIZED ({local.get(name) or BLOCKS[name][1]})" for name in order]
    return (f"WITH {', '.join(bodies)} " if bodies else "") + final


def _mentions(body: str, name: str) -> bool:
    return name in body.replace("(", " ").replace(")", " ").replace(",", " ").split()

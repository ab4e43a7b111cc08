"""DuckDB SQL of the base tables, put before the SQL of each query."""

from __future__ import annotations

import re

from .base import LEVELS, N_PACKETS, N_STATES

_LEVELS = ", ".join(f"({i}, CAST({x} AS DOUBLE))" for i, x in enumerate(LEVELS))

#: Name -> body; a body may use the tables before it.
TABLES = {
    "sentences": r"""SELECT doc_id, len(s) AS n, generate_subscripts(s, 1) - 1 AS idx, unnest(s) AS sentence FROM (
        SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[.!?\n]+'), lambda x: regexp_matches(x, '[\p{L}\p{N}_]+')) AS s FROM documents)""",
    "packet_sentences": f"SELECT doc_id, n, idx, sentence, len(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]+')) AS tokens, CAST(idx * {N_PACKETS} // n AS INT) AS packet_id FROM sentences",
    "packets": f"""SELECT doc_id, packet_id, coalesce(string_agg(sentence, '.' ORDER BY idx), '') AS text, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens
        FROM (SELECT doc_id, CAST(range AS INT) AS packet_id FROM documents, range({N_PACKETS})) LEFT JOIN packet_sentences USING (doc_id, packet_id) GROUP BY ALL""",
    "questions": "SELECT item_id, text AS question FROM benchmark",
    "asked": "SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents",
    "question_terms": r"SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(question), '[\p{L}\p{N}_]+')) AS term FROM questions",
    "packet_words": r"SELECT DISTINCT doc_id, packet_id, unnest(regexp_extract_all(lower(sentence), '[\p{L}\p{N}_]+')) AS term FROM packet_sentences",
    "packet_terms": """SELECT w.doc_id, w.term, w.mask, CAST(t.term IS NOT NULL AS INT) AS is_q FROM (
        SELECT doc_id, term, bit_or(1 << packet_id) AS mask FROM packet_words GROUP BY ALL) w JOIN asked USING (doc_id) LEFT JOIN question_terms t ON t.item_id = asked.item_id AND t.term = w.term""",
    "masks": f"SELECT CAST(range AS INT) AS mask FROM range({N_STATES})",
    "states": """SELECT doc_id, mask, bit_count(mask)::INT AS size, tokens, 2.0 * q / (n + n_q) AS fidelity, q / n_q AS recall FROM (
        SELECT d.doc_id, m.mask, CAST(coalesce(sum(c), 0) AS DOUBLE) AS n, CAST(coalesce(sum(q), 0) AS DOUBLE) AS q FROM documents d CROSS JOIN masks m
        LEFT JOIN (SELECT doc_id, mask, count(*) AS c, sum(is_q) AS q FROM packet_terms GROUP BY ALL) h ON h.doc_id = d.doc_id AND h.mask & m.mask <> 0 GROUP BY d.doc_id, m.mask)
        JOIN (SELECT doc_id, m.mask, CAST(coalesce(sum(tokens) FILTER (m.mask & (1 << packet_id) <> 0), 0) AS BIGINT) AS tokens FROM packets, masks m GROUP BY doc_id, m.mask) USING (doc_id, mask)
        JOIN asked USING (doc_id) JOIN (SELECT item_id, count(*)::DOUBLE AS n_q FROM question_terms GROUP BY item_id) USING (item_id)""",
    "levels": f"SELECT * FROM (VALUES {_LEVELS}) t(level_id, level)",
    "packet_overlap": "SELECT p.doc_id, p.packet_id, count(t.term) AS overlap FROM packets p LEFT JOIN packet_terms t ON t.doc_id = p.doc_id AND t.is_q = 1 AND t.mask & (1 << p.packet_id) <> 0 GROUP BY ALL",
    "orders": """SELECT doc_id, 'learned' AS arm, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, packet_id) - 1 AS pos, packet_id FROM packet_overlap
        UNION ALL SELECT doc_id, 'control', row_number() OVER (PARTITION BY doc_id ORDER BY sha256(doc_id || ':' || packet_id)) - 1, packet_id FROM packet_overlap""",
    "prefix_masks": """SELECT doc_id, arm, pos + 1 AS depth, CAST(sum(1 << packet_id) OVER (PARTITION BY doc_id, arm ORDER BY pos) AS INT) AS mask FROM orders
        UNION ALL SELECT DISTINCT doc_id, arm, 0, 0 FROM orders""",
    "prefixes": "SELECT doc_id, arm, depth, mask, tokens, fidelity, recall FROM prefix_masks JOIN states USING (doc_id, mask)",
    "best": "SELECT doc_id, max(fidelity) AS best FROM states GROUP BY doc_id",
    "hits": """SELECT doc_id, arm, depth, level_id, level, tokens, best >= level AS active, CASE WHEN best >= level THEN fidelity >= level END AS hit
        FROM prefixes JOIN best USING (doc_id), levels""",
}


def with_base(body: str) -> str:
    """The body after those base tables that it needs. A body may begin with its own tables, as ``name AS (...), ... SELECT``."""
    order: list[str] = []
    seen: set[str] = set()

    def add(text: str) -> None:
        for name in TABLES:
            if name not in seen and re.search(rf"(?:\bFROM|\bJOIN|,)\s*\(?{name}\b", text):
                seen.add(name)
                add(TABLES[name])
                order.append(name)

    add(body)
    parts = [f"{n} AS MATERIALIZED ({TABLES[n]})" for n in order]
    own = re.match(r"\s*(RECURSIVE\s+)?\w+ AS ", body)
    recursive = "RECURSIVE " if own and own[1] else ""
    body = body.strip().removeprefix("RECURSIVE").strip() if recursive else body.strip()
    head = ", ".join(parts)
    if own:
        return f"WITH {recursive}{head}{', ' if head else ''}{body}"
    return f"WITH {head} {body}" if head else body

"""SQL that says what a query of this subpackage says, where SQL can."""

from __future__ import annotations

import re

from . import divergence, licenses, secrets

CHAT = """
WITH log AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) more(turn, role)),
sized AS (SELECT *, length('<turn role=>' || chr(10) || '</turn>' || chr(10) || replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS shown FROM log),
told AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(shown) AS BIGINT) AS formatted_chars FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM told
"""

#: All pairs of vectors and the closure of their links: small tables only.
EMBEDDINGS = """
WITH RECURSIVE own AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT r, vec_id, e FROM own WHERE vec_id IS NOT NULL AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e)
  AND len(list_filter(e, lambda x: x <> 0)) > 0 AND len(e) = (SELECT mode(len(embedding)) FROM embeddings)),
link AS (SELECT a.r AS p, b.r AS q, b.vec_id FROM usable a JOIN usable b ON a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT r AS p, r AS q FROM usable UNION SELECT reach.p, link.q FROM reach JOIN link ON link.p = reach.q),
roots AS (SELECT p, min(vec_id) AS root FROM reach JOIN usable ON r = q GROUP BY p),
degree AS (SELECT p, count(*) AS n FROM link GROUP BY p)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root = vec_id, true) AS kept
FROM own LEFT JOIN roots ON roots.p = r LEFT JOIN degree ON degree.p = r
"""


def _ascii(pattern: str) -> str:
    """pattern with its caseless groups as pairs of letters, since other engines fold more than A-Z."""
    pairs = lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")"
    return re.sub(r"\(\?i:([^()]*)\)", pairs, pattern)


def secret_spans() -> str:
    """Each rule's matches by position, from the gaps before them; rules one after the other."""
    rules, parts = [*secrets.BASE, *secrets.MORE], []
    for k, rule in enumerate(rules):
        pattern = _ascii(rule.pattern).replace("'", "''")
        walk = f"(?s)(.*?)(?:({pattern})|\\z)"
        parts.append(
            f"SELECT r, {k} AS number, '{rule.name}' AS name, sum(length(gap) + length(own)) OVER (PARTITION BY r ORDER BY place) - length(own) AS start, length(own) AS size, own <> '' AND length(regexp_extract(own, '{pattern}', {rule.group})) >= {rule.least} AS fits"
            f" FROM (SELECT r, unnest(regexp_extract_all(t, '{walk}', 1)) AS gap, unnest(regexp_extract_all(t, '{walk}', 2)) AS own, unnest(generate_series(1, len(regexp_extract_all(t, '{walk}', 1)))) AS place FROM docs WHERE regexp_matches(t, '{pattern}')) s"
        )
    counts = ", ".join(f"count(*) FILTER (number = {k}) AS n_{rule.name}" for k, rule in enumerate(secrets.BASE))
    named = ", ".join(f"coalesce(n_{rule.name}, 0) AS n_{rule.name}" for rule in secrets.BASE)
    shown = "string_agg(concat_ws(':', name, CAST(start AS BIGINT), CAST(start + size AS BIGINT)), ',' ORDER BY start, number)"
    return (
        f"WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), hits AS ({' UNION ALL '.join(parts)}),"
        f" told AS (SELECT r, {counts}, {shown} FILTER (number < {len(secrets.BASE)}) AS base, {shown} AS spans FROM hits WHERE fits GROUP BY r)"
        f" SELECT doc_id, {named}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN told USING (r)"
    )



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_labels() -> str:
    """Every run of words whose length comes near a notice, by edit distance; only texts that hold a piece of it.

    Characters beyond ASCII become '~', which no notice holds, so that distances count characters.
    """
    notices = ", ".join(f"({k}, {_quoted(n.label)}, {_quoted(n.text)}, {n.errors}, {len(n.text.split())})" for k, n in enumerate(licenses.NOTICES))
    pieces = ", ".join(f"({k}, {_quoted(piece)})" for k, n in enumerate(licenses.NOTICES) for _, piece in licenses.cut(n))
    phrases = ", ".join(f"({_quoted(p)}, {_quoted(label)}, {len(p.split())})" for p, label in licenses.PHRASES)
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{divergence.UPPER}', '{divergence.LOWER}'), '{licenses.WORD}') AS words FROM documents),
told AS (SELECT r, ' ' || regexp_replace(array_to_string(words, ' '), '[^\x00-\x7F]', '~', 'g') || ' ' AS t FROM docs),
each AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM docs),
phrases(phrase, label, n) AS (VALUES {phrases}),
notices(k, label, notice, errors, n) AS (VALUES {notices}),
pieces(k, piece) AS (VALUES {pieces}),
held AS (SELECT r, phrase, label, n FROM told JOIN phrases ON contains(t, ' ' || phrase || ' ')),
places AS (SELECT r, label, i - 1 AS place FROM (SELECT r, label, phrase, i, string_agg(word, ' ') OVER (PARTITION BY r, phrase ORDER BY i ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING) AS run FROM held JOIN each USING (r)) x WHERE run = phrase),
base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
may AS (SELECT DISTINCT r, k FROM told JOIN pieces ON contains(t, piece)),
widths AS (SELECT r, k, label, notice, errors, unnest(generate_series(greatest(1, n - errors), n + errors)) AS width FROM may JOIN notices USING (k)),
plain AS (SELECT r, i, regexp_replace(word, '[^\x00-\x7F]', '~', 'g') AS word FROM each WHERE r IN (SELECT r FROM may)),
shown AS (SELECT r, k, label, notice, errors, string_agg(word, ' ') OVER (PARTITION BY r, k, width ORDER BY i ROWS BETWEEN CURRENT ROW AND width - 1 FOLLOWING) AS run FROM widths JOIN plain USING (r)),
near AS (SELECT r, k, label, min(levenshtein(run, notice)) AS d, any_value(length(notice)) AS size FROM shown WHERE abs(length(run) - length(notice)) <= errors AND levenshtein(run, notice) <= errors GROUP BY ALL),
all_labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION SELECT r, label FROM near) x GROUP BY r),
best AS (SELECT r, max(1 - CAST(d AS DOUBLE) / size) AS score FROM near GROUP BY r)
SELECT doc_id, CAST(len(docs.words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0) END AS score FROM docs LEFT JOIN base USING (r) LEFT JOIN all_labels USING (r) LEFT JOIN best USING (r)
"""


#: Shares as whole numbers of arbitrary size; every pair of a language's sources, term by term.
DIVERGENCE = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{divergence.UPPER}', '{divergence.LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
parts AS (SELECT DISTINCT lang, source FROM docs),
occurrences AS (SELECT r, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM occurrences GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
counts AS (SELECT lang, source, term, count(*) AS n FROM occurrences GROUP BY ALL),
grid AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM parts JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
shares AS (SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * CAST(n + 5 AS HUGEINT) // CAST(sum(n) OVER (PARTITION BY lang, source) + 5 * v AS HUGEINT) AS p FROM grid JOIN sizes USING (lang)),
wholes AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * CAST(sum(n) + 5 AS HUGEINT) // CAST(sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v) AS HUGEINT) AS q FROM grid JOIN sizes USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM parts a JOIN parts b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM shares JOIN wholes USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

SQL = {"op3_chat": CHAT, "op6_embeddings": EMBEDDINGS, "op8_secrets": secret_spans(), "op12_licenses": license_labels(), "op13_divergence": DIVERGENCE}

"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quillvec.llm import quality_rules as rules
from quillvec.llm.lines import FAR, NEAR, PIECES, SENTENCES, WIDE, WORD_CHARS

SPACES = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 25


def count_of(column: str, characters: str) -> str:
    quoted = characters.replace("'", "''")
    return f"(length({column}) - length(translate({column}, '{quoted}', '')))"


def words(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, '{SPACES}'), lambda x: x <> '')"


ENDS = rules.ENDS.replace("'", "''")
OP5 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {words("t")} AS ws FROM d),
g AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
repeated AS (SELECT r, count(DISTINCT i + s) AS n FROM twice, (VALUES (0), (1), (2)) v(s) GROUP BY r),
l AS (SELECT r, l, row_number() OVER (PARTITION BY r ORDER BY p DESC) = 1 AS last FROM (SELECT r, unnest(string_split(t, chr(10))) AS l, unnest(range(len(string_split(t, chr(10))))) AS p FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
lw AS (SELECT r, l, last, {words("l")} AS ws FROM l),
judged AS (SELECT r, l, len(ws) AS n, (instr('{ENDS}', right(rtrim(l, ' '), 1)) = 0 AND NOT (last AND len(ws) >= {rules.CUT_OFF}))
  OR ({count_of("l", rules.SEPARATORS)} >= 3 AND 5 * {count_of("l", rules.SEPARATORS)} >= len(ws)) OR 2 * {count_of("l", rules.MARKS)} >= len(ws) OR (len(ws) >= 5 AND upper(l) = l AND lower(l) <> l)
  OR (len(ws) >= 10 AND 4 * len(list_distinct(ws)) <= len(ws)) OR (len(ws) <= {rules.SHORT} AND regexp_matches(lower(l), '{rules.BOILERPLATE}')) AS fails FROM lw),
by_doc AS (SELECT r, count(*) - count(DISTINCT l) AS dup, count(*) FILTER (fails) AS gone, coalesce(sum(n) FILTER (fails), 0) AS lost FROM judged GROUP BY r),
base AS (SELECT r, doc_id, len(ws)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars, {count_of("t", rules.SYMBOLS)}::BIGINT AS n_symbols,
  coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0)::BIGINT AS lines_removed, coalesce(lost, 0)::BIGINT AS words_removed
  FROM w LEFT JOIN by_doc USING (r) LEFT JOIN repeated USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * words_removed <= 30 * n_words AS kept, lines_removed, words_removed FROM base"""

def units(after: str) -> str:
    """Logical lines of all documents: place, offsets, weight and words in normal form."""
    both = after + "".join(c.upper() for c in after if c.isalpha())
    return f"""WITH cut AS (SELECT doc_id, unnest(parts) AS u, unnest(range(1, len(parts) + 1)) AS p FROM (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), chr(10), chr(10) || chr(30), 'g'), '([{both}] )', '\\1' || chr(30), 'g'), '([{WIDE}])', '\\1' || chr(30), 'g'), chr(30)) AS parts FROM documents)),
ends AS (SELECT *, sum(length(u)) OVER (PARTITION BY doc_id ORDER BY p)::BIGINT AS e FROM cut),
worded AS (SELECT doc_id, e, {words("u")} AS ws, array_to_string({words("lower(u)")}, ' ') AS norm, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM ends WHERE regexp_matches(u, '[^\\x20\\x09-\\x0D]')),
units AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY k), 0) AS s, greatest(len(ws), length(norm) // {WORD_CHARS}) AS w FROM worded)
"""


def spans(marked: str, count: str) -> str:
    """Runs of `marked(doc_id, k)` as the queries show them."""
    return f""", islands AS (SELECT u.*, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS g FROM units u WHERE (doc_id, k) IN (SELECT doc_id, k FROM {marked})),
runs AS (SELECT doc_id, g, min(s) AS s, max(e) AS e, sum(w) AS w FROM islands GROUP BY 1, 2)
SELECT doc_id, (SELECT count(*) FROM units u WHERE u.doc_id = r.doc_id)::BIGINT AS {count}, count(*)::BIGINT AS n_removed, sum(w)::BIGINT AS words_removed, string_agg(s || '-' || e, ' ' ORDER BY s) AS removed FROM runs r GROUP BY doc_id"""


def beside(side: str) -> str:
    """Words beside a unit that are the same beside its first copy: 12, 6 or none."""
    cut = {"before": lambda t, n: f"{t}.dw[{t}.c - {n} + 1 : {t}.c]", "after": lambda t, n: f"{t}.dw[{t}.c + len({t}.ws) + 1 : {t}.c + len({t}.ws) + {n}]"}[side]
    room = {"before": lambda t, n: f"{t}.c >= {n}", "after": lambda t, n: f"{t}.c + len({t}.ws) + {n} <= len({t}.dw)"}[side]
    same = lambda n: f"({room('u', n)} AND {room('f', n)} AND {cut('u', n)} = {cut('f', n)})"
    return f"CASE WHEN {same(FAR)} THEN {FAR} WHEN {same(NEAR)} THEN {NEAR} ELSE 0 END"


OP2 = units(SENTENCES) + f""", placed AS (SELECT u.*, (sum(len(ws)) OVER (PARTITION BY u.doc_id ORDER BY k))::BIGINT - len(ws) AS c, dw FROM units u JOIN (SELECT doc_id, {words("lower(text)")} AS dw FROM documents) d ON u.doc_id = d.doc_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, k) AS copy FROM placed),
later AS (SELECT u.doc_id, u.k, u.w, u.w + {beside("before")} + {beside("after")} >= {LEAST_WORDS} AS alone, u.k - row_number() OVER (PARTITION BY u.doc_id ORDER BY u.k) AS stretch
  FROM numbered u JOIN numbered f ON u.norm = f.norm AND f.copy = 1 WHERE u.copy > 1),
gone AS (SELECT doc_id, k FROM later QUALIFY alone OR sum(w) OVER (PARTITION BY doc_id, stretch) >= {LEAST_WORDS})""" + spans("gone", "n_units")

OP3 = units(PIECES) + f""", sums AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS c FROM units),
whole AS (SELECT doc_id, list(norm ORDER BY k) AS norms FROM units GROUP BY 1),
windows AS (SELECT a.doc_id, a.k AS f, b.k AS l, norms[a.k:b.k] AS content FROM (SELECT *, c - w + {LEAST_WORDS} AS target FROM sums) a ASOF JOIN sums b ON a.doc_id = b.doc_id AND a.target <= b.c JOIN whole ON a.doc_id = whole.doc_id),
later AS (SELECT doc_id, f, l FROM windows QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, f) > 1),
covered AS (SELECT DISTINCT u.doc_id, u.k FROM units u JOIN later x ON u.doc_id = x.doc_id AND u.k BETWEEN x.f AND x.l)""" + spans("covered", "n_lines")

ORACLE_SQL = {"op2_substring_dedup": OP2, "op3_line_dedup": OP3, "op5_quality_rules": OP5}

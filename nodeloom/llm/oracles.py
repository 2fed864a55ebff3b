"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from nodeloom.llm.quality import RULES, STOP_WORDS
from nodeloom.llm.substrings import WIDTH

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def substrings() -> str:
    return f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word, len(ws) AS n FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + {WIDTH - 1}], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WIDTH - 2})) AS i FROM w WHERE len(ws) >= {WIDTH})),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM late, range(0, {WIDTH}) t(o)),
kept AS (SELECT p.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p.i) AS text FROM pos p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i WHERE g.i IS NULL GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""


def quality() -> str:
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(STOP_WORDS)))
    rules = " AND ".join(f"{r.measure} {op} {x!r}" for r in RULES for op, x in ((">=", r.least), ("<=", r.most)) if abs(x) != float("inf"))
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
per AS (SELECT doc_id, sum(len(word)) AS word_chars, count(*) FILTER (lower(word) IN ({stops})) AS stops, count(*) FILTER (len(word) > 30) AS longs FROM pos GROUP BY 1),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, range(0, 3) t(o) GROUP BY 1),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM w),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n FROM line WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, stops, longs, n_lines
 FROM w LEFT JOIN per ON per.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN dup ON dup.doc_id = w.doc_id),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_ratio,
 coalesce(stops / nullif(n_words, 0), 0) AS stop_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_ratio, coalesce(longs / nullif(n_words, 0), 0) AS long_word_ratio FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept FROM r"""


def near_duplicates(width: int, at_least: int) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + {width - 1}], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {width - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {at_least} * (x.n + y.n - c)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM w UNION SELECT reach.d, link.b FROM reach JOIN link ON link.a = reach.r),
c AS (SELECT d, min(r) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN c ON c.d = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""

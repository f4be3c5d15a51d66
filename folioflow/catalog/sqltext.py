"""Pieces of SQL that the checks share, in the dialect of the checking engine."""

from __future__ import annotations

SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# One project per source; paths, ignored folders and file kinds follow from the document number.
REL_PATH = """concat(
  CASE CAST(FLOOR(doc_id / 20) AS BIGINT) % 8
    WHEN 0 THEN '' WHEN 1 THEN 'src/' WHEN 2 THEN 'src/pkg/' WHEN 3 THEN 'tests/'
    WHEN 4 THEN 'docs/' WHEN 5 THEN 'build/out/' WHEN 6 THEN '.venv/lib/' ELSE 'src/env/' END,
  CASE WHEN CAST(FLOOR(doc_id / 20) AS BIGINT) % 25 = 7
    THEN concat('p', CAST(doc_id AS VARCHAR(20)), '/__init__.py')
    ELSE concat('d', CAST(doc_id AS VARCHAR(20)),
      CASE CAST(FLOOR(doc_id / 20) AS BIGINT) % 5
        WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.txt' WHEN 3 THEN '.log' ELSE '.pyc' END)
    END)"""

FILES = f"""files AS (
SELECT source AS project_id, doc_id, lang, text AS content, n_chars AS size,
  1704067200 + doc_id * 3600 AS mtime_s, {REL_PATH} AS rel_path
FROM documents)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def norm(x: str) -> str:
    return f"regexp_replace({strip(x)}, '{SPACE}+', ' ', 'g')"


def base(x: str) -> str:
    return f"string_split({x}, '/')[-1]"


def parent(x: str) -> str:
    return f"array_to_string(string_split({x}, '/')[1:-2], '/')"


def prefixes(x: str, v: str = "i") -> str:
    return f"list_transform(range(1, len(string_split({x}, '/')) + 1), lambda {v}: array_to_string(string_split({x}, '/')[1:{v}], '/'))"


def escape_all(x: str) -> str:
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        x = f"replace({x}, {quoted(char)}, '{entity}')"
    return x


def escape_some(x: str) -> str:
    return f"replace(replace({x}, '&', '&amp;'), '<', '&lt;')"


def tokens(x: str) -> str:
    return f"CAST(greatest(1, length({x}) // 4) AS BIGINT)"


TOKEN_PATTERN = r'token\s*=\s*"[0-9a-f]{32,}"'

# Documents as files after redaction and counting.
READ = f"""scrubbed AS (
SELECT *, array_to_string(list_transform(string_split(content, chr(10)),
  lambda l: regexp_replace(l, '{TOKEN_PATTERN}', '<redacted reason="secret">', 'gi')), chr(10)) AS clean
FROM files),
read_files AS (
SELECT project_id, rel_path, doc_id, size, clean AS content, {tokens('clean')} AS tokens,
  CASE WHEN clean = content THEN 'read_ok' ELSE 'read_scrubbed' END AS status
FROM scrubbed)"""

# One small hunk per document; see `fixtures.hunks`.
HUNKS = f"""{FILES},
hunks AS (
SELECT doc_id AS response_id, 0 AS hunk_pos, project_id, rel_path, content, L, n, k,
  ['-' || gone, '+' || L[k + 1] || ' [edited]'] AS hunk_lines,
  CASE WHEN k > 0 THEN [L[k]] ELSE [] END AS cb, CASE WHEN k < n - 1 THEN [L[k + 2]] ELSE [] END AS ca
FROM (SELECT *, CASE doc_id % 10 WHEN 8 THEN replace(L[k + 1], ' ', '  ')
        WHEN 9 THEN 'NO SUCH LINE ' || doc_id ELSE L[k + 1] END AS gone
      FROM (SELECT *, doc_id % n AS k FROM (SELECT *, len(L) AS n FROM (SELECT *, string_split(content, chr(10)) AS L FROM files)))))"""

# Hunks over every line of a document; those of every fourth document reach one line into the next.
MANY_HUNKS = f"""{FILES},
hunks AS (
SELECT doc_id AS response_id, i AS hunk_pos, project_id, rel_path, content, L, n,
  ['-' || gone, '+' || gone || ' [edited]', '+more'] AS hunk_lines, cb, ca
FROM (SELECT *, CASE WHEN len(c) > 1 THEN c[1:1] ELSE [] END AS cb, CASE WHEN len(c) > 1 THEN c[2] ELSE c[1] END AS gone,
        CASE WHEN len(c) > 1 THEN c[3:] ELSE [] END AS ca
      FROM (SELECT *, L[3 * i + 1:3 * i + 3 + (CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END)] AS c
            FROM (SELECT *, len(L) AS n, CAST(unnest(range(0, (len(L) + 2) // 3)) AS BIGINT) AS i
                  FROM (SELECT *, string_split(content, chr(10)) AS L FROM files)))))"""

# Ten hunks of every document on one file, the one with the most lines.
HOT_HUNKS = f"""{FILES},
hot AS (
SELECT project_id, rel_path, content, L, len(L) AS n FROM (SELECT *, string_split(content, chr(10)) AS L FROM files)
ORDER BY len(L) DESC, doc_id LIMIT 1),
hunks AS (
SELECT response_id, hunk_pos, project_id, rel_path, content, L, n, ['-' || gone, '+' || gone || ' [edited]'] AS hunk_lines,
  CASE WHEN k > 0 THEN [L[k]] ELSE [] END AS cb, CASE WHEN k < n - 1 THEN [L[k + 2]] ELSE [] END AS ca
FROM (SELECT *, CASE response_id % 10 WHEN 8 THEN replace(L[k + 1], ' ', '  ') WHEN 9 THEN 'NO SUCH LINE ' || response_id
        WHEN 7 THEN L[k + 1][:5] ELSE L[k + 1] END AS gone
      FROM (SELECT files.doc_id AS response_id, i AS hunk_pos, hot.*, (files.doc_id * 7 + i * 13) % n AS k
            FROM files, hot, (SELECT unnest(range(10)) AS i))))"""

# Needle, candidate starts and unique exact start of each hunk.
LOCATED = f"""needles AS (
SELECT *, len(cb) AS b, len(needle) AS m FROM (
  SELECT *, list_concat(cb, list_transform(list_filter(hunk_lines, lambda x: NOT starts_with(x, '+')), lambda x: x[2:]), ca) AS needle FROM hunks)),
probes AS (
SELECT *, list_filter(range(b, m), lambda i: {strip('needle[i + 1]')} <> '')[1] AS off FROM needles),
found AS (
SELECT *, CASE WHEN off IS NULL THEN [] ELSE list_filter(
    list_transform(list_filter(range(0, n), lambda i: contains(L[i + 1], {strip('needle[off + 1]')})), lambda i: i - off),
    lambda s: s >= 0 AND s <= n - m) END AS hits FROM probes),
starts AS (
SELECT *, CASE WHEN m > n THEN [] WHEN len(hits) > 0 THEN hits ELSE range(0, n - m + 1) END AS starts FROM found),
exact AS (
SELECT *, list_filter(starts, lambda s: list_transform(L[s + 1:s + m], lambda x: {norm('x')}) = list_transform(needle, lambda y: {norm('y')})) AS exact FROM starts),
located AS (
SELECT *, CASE WHEN len(exact) = 1 THEN exact[1] END AS start,
  CASE WHEN len(exact) = 1 THEN 'matched' ELSE 'unmatched' END AS status FROM exact)"""

"""Parts of SQL that several queries are checked against."""

from __future__ import annotations

from corvane.operators.corpus import CODE_TYPES, NOISE, TYPE_NAME, TYPE_ORDER


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


BLANKS = "' ' || chr(9) || chr(10) || chr(13)"

#: A text with \n as its only line end.
LINED = "replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"

LATEST = f"""
WITH latest AS (
  SELECT * REPLACE (regexp_replace(replace(file_path, '\\', '/'), '^(\\./+)+', '') AS file_path, lower(trim(chunk_type, {BLANKS})) AS chunk_type)
  FROM (SELECT *, row_number() OVER (PARTITION BY chunk_no ORDER BY indexed_at DESC NULLS LAST, repo DESC NULLS LAST, file_path DESC NULLS LAST) AS rn FROM code_chunk WHERE chunk_no IS NOT NULL)
  WHERE rn = 1)
"""

CLEAN = LINED
for _pattern, _kept in NOISE:
    CLEAN = f"regexp_replace({CLEAN}, {quoted(_pattern)}, {quoted(_kept)}, 'g')"


def type_list(source: str) -> str:
    """The distinct names of types in source, as a list."""
    return f"list_filter(list_distinct(regexp_extract_all({CLEAN.format(source)}, {quoted(TYPE_NAME)})), lambda x: regexp_matches(x, '[a-z]'))"


EDGES = (
    LATEST.rstrip()
    + f""", code AS (SELECT * FROM latest WHERE chunk_type IN ({', '.join(map(quoted, CODE_TYPES))}) AND class_name <> ''),
known AS (SELECT DISTINCT repo, class_name AS used_class FROM code),
named AS (SELECT chunk_no, repo, class_name, unnest({type_list('source')}) AS used_class FROM code),
edges AS (SELECT repo, class_name, used_class, count(*) AS n_chunks FROM named SEMI JOIN known USING (repo, used_class) WHERE used_class <> class_name GROUP BY ALL)
"""
)

TYPE_RANK = "CASE chunk_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPE_ORDER)) + " ELSE 99 END"

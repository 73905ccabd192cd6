"""Queries over code: dependency graph by nodes, projections of chunks, lines, sections, suggestions; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import bindings, corpus, dependencies, lines, projections, search, suggestions
from corvane.plans.sql import EDGES, LATEST, LINED, TYPE_RANK, quoted, type_list
from corvane.session import cut_lineage, read_table

HEADING, JSON_KEY, YAML_KEY = r"^#{1,2} ", r'^  "[^"]+" *:', r"^[A-Za-z_][\w.-]*:"
COMMENT, RETURNS = r"^[ \t]*(?://|#|--)", r"^[ \t]*return\b"
SYMBOLS = ["return", "Assembly", "a.b", "self:", "$"]
PAGE = (2, 5)


def _chunks(spark, folder):
    return read_table(spark, folder, "code_chunk")


def _latest(spark, folder):
    return corpus.latest_chunks(_chunks(spark, folder))


def _nodes(spark, folder):
    return cut_lineage(dependencies.nodes(dependencies.references_of_files(_chunks(spark, folder))))


def _flat(df, *columns):
    """df with arrays joined by |."""
    return df.withColumns({c: F.array_join(c, "|") for c in columns})


def type_candidates(spark, folder):
    named = corpus.code_of_classes(_chunks(spark, folder)).select("chunk_no", F.explode(corpus.type_names(F.col("source"))).alias("name"))
    return named


def import_names(spark, folder):
    texts = _latest(spark, folder).select(F.lit("chunk").alias("kind"), F.col("chunk_no").alias("id"), F.col("source").alias("t")).unionByName(
        read_table(spark, folder, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    )
    return texts.select("kind", "id", F.explode(dependencies.import_names(F.regexp_replace("t", r"\r\n?", "\n"))).alias("name"))


def dep_contributions(spark, folder):
    return _flat(dependencies.references_of_files(_chunks(spark, folder)), "refs")


def name_index(spark, folder):
    return _flat(dependencies.name_index(_nodes(spark, folder)), "node_keys")


def dep_totals(spark, folder):
    nodes = _nodes(spark, folder)
    return dependencies.graph_totals(nodes, dependencies.edges(nodes))


def class_dependencies(spark, folder):
    nodes = _nodes(spark, folder)
    return _flat(dependencies.class_dependencies(nodes, dependencies.edges(nodes)), "dependencies", "dependents")


def aggregate_view(spark, folder):
    nodes = _nodes(spark, folder)
    return _flat(dependencies.aggregate_view(nodes, dependencies.edges(nodes)), "files", "dependencies", "dependents")


def module_graph_topn(spark, folder):
    """Modules as assemblies: which modules others refer to."""
    nodes = _nodes(spark, folder)
    of = nodes.where("module <> ''").select("repo", "node_key", F.concat("repo", F.lit("/"), "module").alias("m"))
    edges = dependencies.edges(nodes).join(of.withColumnsRenamed({"node_key": "src", "m": "name"}), ["repo", "src"]).join(of.withColumnsRenamed({"node_key": "dst", "m": "reference"}), ["repo", "dst"])
    kept = edges.where("name <> reference").select("name", "reference").distinct()
    return _flat(bindings.most_referenced(kept, least=1, k=20), "dependents")


def chunk_texts(spark, folder):
    """Identifier, metadata and text to embed of each chunk (the texts as md5)."""
    c = F.col
    rows = _latest(spark, folder)
    text = projections.embedding_text(c("namespace"), c("class_name"), c("base_types"), c("file_path"), c("module"), c("doc_comment"), c("source"))
    name = projections.chunk_id(c("file_path"), c("class_name"), c("method_name"), c("start_line"), c("end_line"))
    snip = projections.snippet(F.regexp_replace("source", r"\r\n?", "\n"))
    return rows.select("chunk_no", name.alias("chunk_id"), F.length(text).alias("n_chars"), F.md5(text).alias("text_hash"), F.md5(snip).alias("snippet_hash"))


def file_chunks_page(spark, folder):
    order = [corpus.type_rank(F.col("chunk_type")), F.col("start_line").asc_nulls_first(), F.col("chunk_no")]
    rows = search.page(_latest(spark, folder), ["repo", "file_path"], order, *PAGE)
    return rows.select("repo", "file_path", "position", "chunk_no", F.col("total").cast("bigint").alias("total"), "next_offset")


def implementations_by_module(spark, folder):
    """The implementers of each type in the order of module and class."""
    rows = corpus.implementations(_chunks(spark, folder)).withColumn("module", F.coalesce("module", F.lit("")))
    order = ["module", "class_name", "repo"]
    numbered = search.numbered(rows, ["repo", "base_type"], [F.col(x) for x in order])
    return numbered.select("repo", "base_type", "position", "module", "class_name", F.col("total").cast("bigint").alias("total"))


def sections(spark, folder):
    documents = read_table(spark, folder, "documents")
    return lines.line_sections(documents, "doc_id", "text", HEADING, least_lines=8)


def key_sections(spark, folder):
    rows = _latest(spark, folder)
    json = lines.line_sections(rows.where("chunk_type = 'json_key'"), "chunk_no", "source", JSON_KEY, least_lines=4)
    yaml = lines.line_sections(rows.where("chunk_type = 'yaml_key'"), "chunk_no", "source", YAML_KEY, least_lines=4)
    return json.unionByName(yaml)


def comment_islands(spark, folder):
    return lines.comment_blocks(_latest(spark, folder), "chunk_no", "source", COMMENT)


def statement_collapse(spark, folder):
    rows = _latest(spark, folder).where("file_path like '%.cs'")
    made = bindings.statements(rows, "chunk_no", "source", RETURNS)
    return made.select("chunk_no", "line_number", F.md5("statement").alias("statement_hash"))


def symbol_matches(spark, folder):
    found = lines.symbol_lines(_latest(spark, folder), "chunk_no", "source", SYMBOLS, whole_word=False)
    return found.select("chunk_no", "line_no", "symbol", F.md5(projections.trimmed_line(F.col("line"), 60)).alias("line_hash"), "n_matches")


def small_and_minified(spark, folder):
    text = F.regexp_replace("source", r"\r\n?", "\n")
    rows = _latest(spark, folder).where("source is not null")
    return rows.select("chunk_no", lines.is_small(text).alias("small"), lines.is_minified(text).alias("minified"))


def _names(spark, folder):
    return read_table(spark, folder, "guid_map").select(F.col("class_name").alias("name"))


def _asked(spark, folder):
    """The classes of packages are looked up among those of the project."""
    return read_table(spark, folder, "package_guid").where("class_name is not null").select(F.col("class_name").alias("asked")).distinct()


def lookup_names(spark, folder):
    return _flat(search.lookup(_asked(spark, folder), _names(spark, folder)), "matches")


QUERIES = {
    "type_candidates": type_candidates,
    "import_names": import_names,
    "dep_contributions": dep_contributions,
    "dep_nodes": lambda spark, folder: _flat(_nodes(spark, folder), "files", "refs"),
    "name_index": name_index,
    "dep_node_edges": lambda spark, folder: dependencies.edges(_nodes(spark, folder)),
    "dep_totals": dep_totals,
    "class_dependencies": class_dependencies,
    "aggregate_view": aggregate_view,
    "module_graph_topn": module_graph_topn,
    "chunk_texts": chunk_texts,
    "file_chunks_page": file_chunks_page,
    "implementations_by_module": implementations_by_module,
    "line_sections": sections,
    "key_sections": key_sections,
    "comment_islands": comment_islands,
    "statement_collapse": statement_collapse,
    "symbol_matches": symbol_matches,
    "small_and_minified": small_and_minified,
    "lookup_names": lookup_names,
    "suggest_words": lambda spark, folder: suggestions.by_shared_words(_asked(spark, folder), _names(spark, folder)),
    "suggest_edits": lambda spark, folder: suggestions.by_edits(_asked(spark, folder), _names(spark, folder)),
    "suggest_similar": lambda spark, folder: suggestions.suggestions(_asked(spark, folder), _names(spark, folder)),
}

_IMPORTS = f"""list_sort(list_filter(list_distinct(list_concat(
  list_transform(flatten(list_transform(list_concat(regexp_extract_all(T, {quoted(dependencies.PYTHON_FROM)}, 1), regexp_extract_all(T, {quoted(dependencies.SCRIPT_NAMED)}, 1)), lambda x: string_split(x, ','))), lambda x: regexp_extract(x, '(\\w+)', 1)),
  list_concat(regexp_extract_all(T, {quoted(dependencies.SCRIPT_DEFAULT)}, 1),
  list_transform(flatten(list_transform(list_concat(regexp_extract_all(T, {quoted(dependencies.REQUIRED)}, 1), regexp_extract_all(T, {quoted(dependencies.INTEROP)}, 1)), lambda x: string_split_regex(x, '[./]'))), lambda x: regexp_extract(x, '(\\w*)', 1))))), lambda x: x <> '' AND x <> 'type'))"""

_NODES = (
    EDGES.rstrip()
    + f""", parts AS (SELECT repo, class_name, file_path, chunk_no, coalesce(namespace, '') AS namespace, coalesce(module, '') AS module, coalesce(list_concat({type_list('source')}, {_IMPORTS.replace('T,', LINED.format('source') + ',')}), []) AS refs FROM code),
contribution AS MATERIALIZED (SELECT repo, class_name, file_path, namespace, module, list_sort(list_filter(list_distinct(r), lambda x: x <> class_name)) AS refs FROM (
  SELECT repo, class_name, file_path, arg_min(namespace, chunk_no) AS namespace, arg_min(module, chunk_no) AS module, flatten(list(refs)) AS r FROM parts GROUP BY ALL)),
keyed AS (SELECT *, CASE WHEN namespace <> '' THEN namespace || '.' || class_name ELSE class_name || '@@' || module || '@@' || coalesce(file_path, '') END AS node_key FROM contribution),
node AS MATERIALIZED (SELECT repo, node_key, min(class_name) AS class_name, min(namespace) AS namespace, coalesce(arg_min(module, file_path) FILTER (module <> ''), '') AS module,
  list_sort(list_distinct(list(file_path))) AS files, list_sort(list_distinct(flatten(list(refs)))) AS refs FROM keyed GROUP BY ALL),
node_edge AS MATERIALIZED (SELECT DISTINCT n.repo, n.node_key AS src, m.node_key AS dst FROM (SELECT repo, node_key, unnest(refs) AS class_name FROM node) n JOIN node m USING (repo, class_name) WHERE n.node_key <> m.node_key),
near AS (SELECT repo, node_key, coalesce(list_sort(list_distinct(list(d) FILTER (d IS NOT NULL))), []) AS dependencies, coalesce(list_sort(list_distinct(list(r) FILTER (r IS NOT NULL))), []) AS dependents FROM (
  SELECT repo, src AS node_key, dst AS d, NULL AS r FROM node_edge UNION ALL SELECT repo, dst, NULL, src FROM node_edge UNION ALL SELECT repo, node_key, NULL, NULL FROM node) GROUP BY ALL)
"""
)

_LINES = "SELECT {key}, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS line FROM (SELECT {key}, string_split({text}, chr(10)) AS p FROM {rows})"


def _sections(key: str, text: str, rows: str, mark: str, least: int) -> str:
    lined = _LINES.format(key=key, text=LINED.format(text), rows=f"(SELECT * FROM {rows} WHERE {text} IS NOT NULL)")
    return f"""(WITH l AS ({lined}), h AS (SELECT *, regexp_matches(line, {quoted(mark)})::INT AS head FROM l),
k AS (SELECT *, sum(head) OVER (PARTITION BY {key} ORDER BY line_no) AS no, count(*) OVER (PARTITION BY {key}) AS n_lines, sum(head) OVER (PARTITION BY {key}) AS heads FROM h),
c AS (SELECT {key}, line_no, line, CASE WHEN n_lines >= {least} AND heads >= 2 THEN no ELSE -1 END AS no FROM k),
s AS (SELECT *, max(CASE WHEN trim(line, ' ') <> '' THEN line_no END) OVER (PARTITION BY {key}, no) AS last FROM c WHERE no <> 0)
SELECT {key}, min(line_no)::INT AS start_line, max(line_no)::INT AS end_line, CASE WHEN no > 0 THEN arg_min(line, line_no) END AS title, (sum(length(line)) + count(*) - 1)::BIGINT AS n_chars FROM s WHERE line_no <= coalesce(last, line_no) GROUP BY {key}, no)"""


_STATEMENTS = f"""WITH rows_of AS (SELECT chunk_no, source FROM latest WHERE file_path LIKE '%.cs' AND source IS NOT NULL),
l AS ({_LINES.format(key='chunk_no', text=LINED.format('source'), rows='rows_of')}),
n AS (SELECT *, sum(regexp_matches(line, {quoted(RETURNS)})::INT) OVER (PARTITION BY chunk_no ORDER BY line_no) AS no FROM l),
o AS (SELECT *, coalesce(max(contains(line, ';')::INT) OVER (PARTITION BY chunk_no, no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM n WHERE no > 0)
SELECT chunk_no, min(line_no)::INT AS line_number, md5(string_split(string_agg(trim(line, ' '), ' ' ORDER BY line_no), ';')[1]) AS statement_hash FROM o WHERE ended = 0 GROUP BY chunk_no, no"""

_WORDS = "list_distinct(list_filter(list_transform(regexp_extract_all({0}, '([A-Z]?[a-z]+|[A-Z]{{2,}})'), lambda w: lower(w)), lambda w: length(w) > 1))"
_ASK = "WITH a AS (SELECT DISTINCT class_name AS asked FROM package_guid WHERE class_name IS NOT NULL), n AS (SELECT DISTINCT class_name AS name FROM guid_map WHERE class_name IS NOT NULL)"
_TEXT = f"""left(concat_ws(chr(10), concat_ws(' ', nullif(namespace, ''), class_name, CASE WHEN len(base_types) > 0 THEN ': ' || array_to_string(base_types, ', ') END),
  'File: ' || coalesce(file_path, '') || CASE WHEN module <> '' THEN ' | Module: ' || module ELSE '' END, CASE WHEN doc_comment <> '' THEN chr(10) || doc_comment END, '', left(coalesce(source, ''), 5000)), 5000)"""
_SNIP = "CASE WHEN len(p) > 20 THEN array_to_string(p[1:20], chr(10)) || chr(10) || '... ' || (len(p) - 20) || ' more' ELSE array_to_string(p, chr(10)) END"
_MATCHES = " UNION ALL ".join(
    f"SELECT chunk_no, line_no, {quoted(s)} AS symbol, line, len(regexp_extract_all(line, {quoted(''.join(c if c.isalnum() else chr(92) + c for c in s))})) AS n_matches FROM l" for s in SYMBOLS
)
_TRIM = "regexp_replace(line, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"

ORACLE = {
    "type_candidates": EDGES.rstrip() + f" SELECT chunk_no, unnest({type_list('source')}) AS name FROM code",
    "import_names": LATEST + f"SELECT kind, id, unnest({_IMPORTS.replace('T,', 't,')}) AS name FROM (SELECT 'chunk' AS kind, chunk_no AS id, {LINED.format('source')} AS t FROM latest UNION ALL SELECT 'document', doc_id, {LINED.format('text')} FROM documents)",
    "dep_contributions": _NODES + "SELECT repo, class_name, file_path, namespace, module, array_to_string(refs, '|') AS refs FROM contribution",
    "dep_nodes": _NODES + "SELECT repo, node_key, class_name, namespace, module, array_to_string(files, '|') AS files, array_to_string(refs, '|') AS refs FROM node",
    "name_index": _NODES + "SELECT repo, class_name, array_to_string(list_sort(list_distinct(list(node_key))), '|') AS node_keys FROM node GROUP BY ALL",
    "dep_node_edges": _NODES + "SELECT repo, src, dst FROM node_edge",
    "dep_totals": _NODES + "SELECT repo, sum(n)::BIGINT AS n_nodes, sum(e)::BIGINT AS n_edges FROM (SELECT repo, 1 AS n, 0 AS e FROM node UNION ALL SELECT repo, 0, 1 FROM node_edge) GROUP BY ALL",
    "class_dependencies": _NODES + "SELECT repo, node_key, array_to_string(dependencies, '|') AS dependencies, array_to_string(dependents, '|') AS dependents FROM near",
    "aggregate_view": _NODES
    + """, merged AS (SELECT repo, class_name, count(*) AS n_nodes, list(node_key) AS own, list_distinct(flatten(list(files))) AS f, list_distinct(flatten(list(dependencies))) AS d, list_distinct(flatten(list(dependents))) AS r FROM node JOIN near USING (repo, node_key) GROUP BY ALL)
SELECT repo, class_name, n_nodes, array_to_string(list_sort(f), '|') AS files, array_to_string(list_sort(list_filter(d, lambda x: NOT list_contains(own, x))), '|') AS dependencies, array_to_string(list_sort(list_filter(r, lambda x: NOT list_contains(own, x))), '|') AS dependents FROM merged WHERE n_nodes > 1""",
    "module_graph_topn": _NODES
    + """, place AS (SELECT repo, node_key, repo || '/' || module AS m FROM node WHERE module <> ''),
link AS (SELECT DISTINCT a.m AS name, b.m AS reference FROM node_edge e JOIN place a ON a.repo = e.repo AND a.node_key = e.src JOIN place b ON b.repo = e.repo AND b.node_key = e.dst WHERE a.m <> b.m)
SELECT reference AS name, count(*)::INT AS n_dependents, array_to_string(list_sort(list(name)), '|') AS dependents FROM link GROUP BY ALL ORDER BY n_dependents DESC, name LIMIT 20""",
    "chunk_texts": LATEST
    + f"""SELECT chunk_no, concat_ws('__', replace(translate(file_path, '\\/', '__'), ':', ''), class_name, nullif(method_name, ''), 'L' || start_line || '-' || end_line) AS chunk_id, length(t)::INT AS n_chars, md5(t) AS text_hash, md5({_SNIP}) AS snippet_hash
FROM (SELECT *, {_TEXT} AS t, string_split({LINED.format('source')}, chr(10)) AS p FROM latest)""",
    "file_chunks_page": LATEST
    + f"""SELECT repo, file_path, position::INT AS position, chunk_no, total, CASE WHEN total > {sum(PAGE)} THEN {sum(PAGE)} END::INT AS next_offset FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, file_path ORDER BY {TYPE_RANK}, start_line NULLS FIRST, chunk_no) AS position, count(*) OVER (PARTITION BY repo, file_path) AS total FROM latest) WHERE position > {PAGE[0]} AND position <= {sum(PAGE)}""",
    "implementations_by_module": LATEST
    + """SELECT repo, base_type, (row_number() OVER (PARTITION BY repo, base_type ORDER BY module, class_name, repo))::INT AS position, module, class_name, count(*) OVER (PARTITION BY repo, base_type) AS total FROM (
  SELECT DISTINCT regexp_replace(trim(b, ' ' || chr(9) || chr(10) || chr(13)), '<.*$', '') AS base_type, class_name, repo, coalesce(module, '') AS module FROM (SELECT unnest(base_types) AS b, class_name, repo, module FROM latest WHERE class_name <> '')) WHERE base_type <> ''""",
    "line_sections": "SELECT * FROM " + _sections("doc_id", "text", "documents", HEADING, 8),
    "key_sections": LATEST + "SELECT * FROM " + _sections("chunk_no", "source", "(SELECT * FROM latest WHERE chunk_type = 'json_key')", JSON_KEY, 4) + " UNION ALL SELECT * FROM " + _sections("chunk_no", "source", "(SELECT * FROM latest WHERE chunk_type = 'yaml_key')", YAML_KEY, 4),
    "comment_islands": LATEST
    + f""", l AS ({_LINES.format(key='chunk_no', text=LINED.format('source'), rows='latest')}), f AS (SELECT *, line_no - row_number() OVER (PARTITION BY chunk_no ORDER BY line_no) AS island FROM l WHERE regexp_matches(line, {quoted(COMMENT)}))
SELECT chunk_no, min(line_no)::INT AS start_line, max(line_no)::INT AS end_line, count(*) AS n_lines FROM f GROUP BY chunk_no, island""",
    "statement_collapse": LATEST.rstrip() + ", " + _STATEMENTS.removeprefix("WITH "),
    "symbol_matches": LATEST + f""", l AS ({_LINES.format(key='chunk_no', text=LINED.format('source'), rows='latest')})
SELECT chunk_no, line_no::INT AS line_no, symbol, md5(CASE WHEN length(b) > 60 THEN left(b, 60) || '...' ELSE b END) AS line_hash, n_matches::INT AS n_matches FROM (SELECT *, {_TRIM} AS b FROM ({_MATCHES}) WHERE n_matches > 0)""",
    "small_and_minified": LATEST + f"SELECT chunk_no, len(string_split(t, chr(10))) < 150 AS small, strlen(t) / len(string_split(t, chr(10))) > 200 AS minified FROM (SELECT chunk_no, {LINED.format('source')} AS t FROM latest WHERE source IS NOT NULL)",
    "lookup_names": _ASK
    + """, m AS (SELECT asked, coalesce(bool_or(name = asked), false) AS exact, coalesce(list_sort(list(name) FILTER (name IS NOT NULL)), []) AS near FROM a LEFT JOIN n ON contains(lower(name), lower(asked)) GROUP BY ALL)
SELECT asked, CASE WHEN exact OR len(near) = 1 THEN 'found' WHEN len(near) = 0 THEN 'not_found' ELSE 'disambiguation' END AS status, CASE WHEN exact THEN asked ELSE array_to_string(near, '|') END AS matches FROM m""",
    "suggest_words": _ASK
    + f""", aw AS (SELECT asked, unnest({_WORDS.format('asked')}) AS w FROM a), nw AS (SELECT name, unnest({_WORDS.format('name')}) AS w FROM n),
s AS (SELECT asked, name, count(*) AS n_shared FROM aw JOIN nw USING (w) WHERE name <> asked GROUP BY ALL)
SELECT * FROM (SELECT asked, (row_number() OVER (PARTITION BY asked ORDER BY n_shared DESC, name))::INT AS rank, name, n_shared FROM s) WHERE rank <= 5""",
}

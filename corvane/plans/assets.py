"""Queries over assets and searches over vectors and chunks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import assets, corpus, retrieval, search
from corvane.operators.nearest import nearest
from corvane.plans.sql import BLANKS, EDGES, LINED, TYPE_RANK, quoted
from corvane.session import cut_lineage, read_table

FILTER, LOW = {"label": 3}, 1.5


def _components(spark, folder):
    return read_table(spark, folder, "mono_behaviour")


def _scripts(spark, folder):
    return assets.scripts_by_guid(read_table(spark, folder, t) for t in ("guid_map", "package_guid"))


def _flat(df, *columns):
    return df.withColumns({c: F.array_join(c, "|") for c in columns})


def asset_objects(spark, folder):
    made = assets.asset_objects(read_table(spark, folder, "documents"), "doc_id", "text")
    fields = F.array_join(F.transform("properties", lambda p: F.concat(p["field"], F.lit("="), p["value"])), "|")
    return made.select("doc_id", "position", "class_id", "file_id", "type_name", "name", "stripped", F.array_join("links", "|").alias("links"), F.md5(fields).alias("fields_hash"))


def guid_left_fallback(spark, folder):
    named = assets.component_names(_components(spark, folder).select("mb_no", "asset_path", "script_guid").distinct(), _scripts(spark, folder))
    return named.select("mb_no", "asset_path", "script_guid", "shown_name")


def asset_refs_by_file(spark, folder):
    return _flat(assets.asset_references(_components(spark, folder), _scripts(spark, folder)), "prefabs", "scenes", "others")


def asset_refs_by_class(spark, folder):
    return _flat(assets.class_references_in_assets(_components(spark, folder), _scripts(spark, folder)), "files")


def object_components(spark, folder):
    return _flat(assets.object_components(_components(spark, folder), _scripts(spark, folder)), "scripts")


def file_id_objects(spark, folder):
    """What the parents of transforms mean: objects with components, or objects through their transform."""
    transforms = read_table(spark, folder, "transform_info").select("asset_path", "file_id", "go_file_id", "parent_id").distinct()
    links = transforms.where("parent_id <> '' and parent_id <> '0'").select("asset_path", F.trim("parent_id").alias("link"))
    objects = _components(spark, folder).where("go_file_id <> '0'").select("asset_path", F.col("go_file_id").alias("file_id")).distinct()
    return assets.object_of(links, objects, transforms)


def telling_properties(spark, folder):
    return assets.telling_properties(_components(spark, folder))


def _vectors(spark, folder):
    return read_table(spark, folder, "embeddings")


def _queries(spark, folder):
    return _vectors(spark, folder).where(F.col("vec_id") % 50 == 0)


def knn_filtered_page(spark, folder):
    made = search.filtered_page(_vectors(spark, folder), _queries(spark, folder), FILTER, offset=2, limit=4, low=LOW)
    return made.select("query_id", "position", "vec_id")


def knn_prefix_filter(spark, folder):
    """Nearest among the vectors below a folder; a vector's path is made of its label and id."""
    labelled = _vectors(spark, folder).withColumn("path", F.concat(F.lit("docs_"), F.col("label").cast("string"), F.lit("\\"), F.col("vec_id").cast("string")))
    made = nearest(search.under_prefix(labelled, "path", "docs_1/"), _queries(spark, folder), k=5)
    return made.select("query_id", "rank", "vec_id")


def multi_collection_merge(spark, folder):
    """Each label is a collection; the four best of each are merged by score."""
    vectors = _vectors(spark, folder)
    parts = None
    for label in range(10):
        one = nearest(vectors.where(F.col("label") == label), _queries(spark, folder), k=4, distance="d").withColumn("collection", F.lit(str(label)))
        parts = one if parts is None else parts.unionByName(one)
    scored = parts.withColumn("score", F.round(retrieval.score(F.col("d"), F.lit(0.5), F.lit(1.0), F.lit(2.0)), 4))
    return search.merge_collections(scored, 8).select("query_id", "position", "collection", "vec_id", "score")


def top3_per_class(spark, folder):
    rows = corpus.code_of_classes(read_table(spark, folder, "code_chunk"))
    order = [corpus.type_rank(F.col("chunk_type")), F.col("start_line").asc_nulls_first(), F.col("chunk_no")]
    return search.first_per_group(rows, ["repo", "class_name"], order).select("repo", "class_name", "rank", "chunk_no")


def associative_search(spark, folder):
    """Hits are the first ten chunks of each repository that are classes; they are expanded along the dependencies."""
    chunks = read_table(spark, folder, "code_chunk")
    rows = cut_lineage(corpus.code_of_classes(chunks).select("repo", "chunk_no", "class_name", corpus.type_rank(F.col("chunk_type")).alias("type_rank"), "start_line", "chunk_type"))
    hits = search.first_per_group(rows.where("chunk_type = 'whole_class'"), ["repo"], [F.col("chunk_no")], 10)
    found = search.expand_hits(hits.select("repo", "chunk_no", "rank"), cut_lineage(corpus.dependencies(chunks)), rows, 20)
    return found.withColumn("fused", F.round("fused", 9))


QUERIES = {
    "asset_objects": asset_objects,
    "guid_left_fallback": guid_left_fallback,
    "asset_refs_by_file": asset_refs_by_file,
    "asset_refs_by_class": asset_refs_by_class,
    "object_components": object_components,
    "file_id_objects": file_id_objects,
    "telling_properties": telling_properties,
    "knn_filtered_page": knn_filtered_page,
    "knn_prefix_filter": knn_prefix_filter,
    "multi_collection_merge": multi_collection_merge,
    "top3_per_class": top3_per_class,
    "associative_search": associative_search,
}

_GUID = f"lower(replace(trim({{0}}, {BLANKS}), '-', ''))"
_SCRIPTS = f"""WITH known AS (SELECT {_GUID.format('guid')} AS script_guid, script_path, class_name FROM (SELECT guid, script_path, class_name FROM guid_map UNION ALL SELECT guid, script_path, class_name FROM package_guid)),
script AS (SELECT script_guid, class_name, script_path FROM (SELECT *, row_number() OVER (PARTITION BY script_guid ORDER BY script_path NULLS FIRST, class_name NULLS FIRST) AS rn FROM known WHERE script_guid <> '') WHERE rn = 1),
used AS (SELECT DISTINCT {_GUID.format('script_guid')} AS script_guid, asset_path FROM mono_behaviour WHERE {_GUID.format('script_guid')} <> '')
"""
_KIND = "CASE WHEN lower(asset_path) LIKE '%.prefab' THEN 'prefab' WHEN lower(asset_path) LIKE '%.unity' THEN 'scene' ELSE 'other' END"
_SHOWN = "coalesce(s.class_name, CASE WHEN m.g <> '' THEN '[' || left(m.g, 8) || '...]' END)"
_OF = "array_to_string(coalesce(list_sort(list_distinct(list(asset_path) FILTER (kind = '{0}'))), []), '|') AS {0}s"
_CLASS = "CASE class_id " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in assets.CLASS_NAMES.items()) + " ELSE 'Component_' || class_id END"
_D = "list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) ** 2"
_EMPTY = ", ".join(map(quoted, assets.EMPTY_VALUES))

ORACLE = {
    "asset_objects": f"""WITH part AS (SELECT doc_id, p, i - 1 AS position FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS p FROM (
  SELECT doc_id, string_split(regexp_replace({LINED.format('text')}, '(?m)^(--- !u!\\d+ &)', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM documents WHERE text IS NOT NULL))),
obj AS (SELECT doc_id, position - CASE WHEN regexp_matches(f, '^--- !u!\\d+ &') THEN 1 ELSE 0 END AS position, p, TRY_CAST(regexp_extract(p, '^--- !u!(\\d+) &(-?\\d+)([^\\n]*)', 1) AS INT) AS class_id, regexp_extract(p, '^--- !u!(\\d+) &(-?\\d+)([^\\n]*)', 2) AS file_id, regexp_extract(p, '^--- !u!(\\d+) &(-?\\d+)([^\\n]*)', 3) AS rest
  FROM part JOIN (SELECT doc_id, {LINED.format('text')} AS f FROM documents) USING (doc_id) WHERE regexp_matches(p, '^--- !u!\\d+ &-?\\d+')),
made AS (SELECT *, regexp_extract(p, '(?m)^(\\w+):[ \\t]*$', 1) AS kind, list_transform(regexp_extract_all(p, '(?m)^(?:  |    )([A-Za-z]\\w*: *[^ \\t\\n\\x0B\\f\\r][^\\n]*)$', 1), lambda x: {{'f': string_split(x, ':')[1], 'v': trim(regexp_replace(x, '^\\w+:', ''), ' ')}}) AS fields FROM obj)
SELECT doc_id, position::INT AS position, class_id, file_id, CASE WHEN kind <> '' THEN kind ELSE {_CLASS} END AS type_name, trim(regexp_extract(p, '(?m)^  m_Name:([^\\n]*)$', 1), ' ') AS name, contains(rest, 'stripped') AS stripped,
array_to_string(list_filter(regexp_extract_all(p, '\\{{fileID: (-?\\d+)', 1), lambda x: x <> '0'), '|') AS links,
md5(array_to_string(list_transform(list_filter(fields, lambda x: NOT starts_with(x.f, 'm_') AND x.v NOT IN ({_EMPTY})), lambda x: x.f || '=' || x.v), '|')) AS fields_hash
FROM made WHERE class_id NOT IN ({', '.join(map(str, assets.SETTINGS_IDS))})""",
    "guid_left_fallback": _SCRIPTS + f"SELECT m.mb_no, m.asset_path, m.g AS script_guid, {_SHOWN} AS shown_name FROM (SELECT mb_no, asset_path, {_GUID.format('script_guid')} AS g FROM (SELECT DISTINCT mb_no, asset_path, script_guid FROM mono_behaviour)) m LEFT JOIN script s ON s.script_guid = m.g",
    "asset_refs_by_file": _SCRIPTS + f"SELECT script_guid, class_name, script_path, {_OF.format('prefab')}, {_OF.format('scene')}, {_OF.format('other')} FROM (SELECT *, {_KIND} AS kind FROM used JOIN script USING (script_guid)) GROUP BY script_guid, class_name, script_path",
    "asset_refs_by_class": _SCRIPTS + "SELECT class_name, count(DISTINCT script_guid) AS n_guids, array_to_string(list_sort(list_distinct(list(asset_path))), '|') AS files FROM used JOIN script USING (script_guid) WHERE class_name <> '' GROUP BY class_name",
    "object_components": _SCRIPTS
    + f""", last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mb_no ORDER BY seen_at DESC NULLS LAST, loaded_at DESC NULLS LAST, asset_path DESC NULLS LAST, go_file_id DESC NULLS LAST, script_guid DESC NULLS LAST) AS rn FROM mono_behaviour) WHERE rn = 1),
m AS (SELECT mb_no, asset_path, trim(go_file_id, {BLANKS}) AS go_file_id, {_GUID.format('script_guid')} AS g FROM last)
SELECT asset_path, go_file_id, array_to_string(coalesce(list_sort(list(shown) FILTER (shown IS NOT NULL)), []), '|') AS scripts, count(*) AS n_components FROM (SELECT m.*, {_SHOWN} AS shown FROM m LEFT JOIN script s ON s.script_guid = m.g WHERE go_file_id <> '' AND go_file_id <> '0') GROUP BY ALL""",
    "file_id_objects": """WITH links AS (SELECT DISTINCT asset_path, trim(parent_id, ' ') AS link FROM transform_info WHERE parent_id <> '' AND parent_id <> '0'),
o AS (SELECT DISTINCT asset_path, go_file_id AS link FROM mono_behaviour WHERE go_file_id <> '0'),
t AS (SELECT asset_path, file_id AS link, min(go_file_id) AS via FROM transform_info WHERE go_file_id IS NOT NULL GROUP BY ALL)
SELECT l.asset_path, l.link, coalesce(o.link, t.via) AS object_id, CASE WHEN o.link IS NOT NULL THEN 'object' WHEN t.via IS NOT NULL THEN 'transform' END AS through FROM links l LEFT JOIN o ON o.asset_path = l.asset_path AND o.link = l.link LEFT JOIN t ON t.asset_path = l.asset_path AND t.link = l.link""",
    "telling_properties": f"""SELECT DISTINCT mb_no, field, value FROM (SELECT mb_no, unnest(json_keys(properties)) AS field, properties FROM mono_behaviour WHERE properties IS NOT NULL AND json_valid(properties)) p, LATERAL (SELECT json_extract_string(properties, '$."' || field || '"') AS value)
WHERE value IS NOT NULL AND NOT starts_with(field, 'm_') AND value NOT IN ({_EMPTY})""",
    "knn_filtered_page": f"""SELECT query_id, (rk - 2)::INT AS position, vec_id FROM (SELECT q.vec_id AS query_id, v.vec_id, {_D} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_D}, 9), v.vec_id) AS rk
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0 AND v.label = 3) WHERE rk > 2 AND rk <= 6 AND d < {LOW}""",
    "knn_prefix_filter": f"""SELECT query_id, rk::INT AS rank, vec_id FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_D}, 9), v.vec_id) AS rk
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0 AND starts_with('docs_' || v.label || '/' || v.vec_id, 'docs_1/')) WHERE rk <= 5""",
    "multi_collection_merge": f"""WITH h AS (SELECT q.vec_id AS query_id, v.vec_id, v.label::VARCHAR AS collection, {_D} AS d, row_number() OVER (PARTITION BY q.vec_id, v.label ORDER BY round({_D}, 9), v.vec_id) AS rk FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, collection, round(CASE WHEN d <= 0 THEN 100 WHEN d <= 0.5 THEN 100 - 15 * d / 0.5::DOUBLE WHEN d <= 1 THEN 85 - 30 * (d - 0.5::DOUBLE) / 0.5::DOUBLE WHEN d <= 2 THEN 55 - 40 * (d - 1) WHEN d <= 2.4 THEN 15 - 15 * (d - 2) / 0.4::DOUBLE ELSE 0 END, 4) AS score FROM h WHERE rk <= 4)
SELECT * FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, collection, vec_id))::INT AS position, collection, vec_id, score FROM s) WHERE position <= 8""",
    "top3_per_class": EDGES.rstrip() + f" SELECT * FROM (SELECT repo, class_name, (row_number() OVER (PARTITION BY repo, class_name ORDER BY {TYPE_RANK}, start_line NULLS FIRST, chunk_no))::INT AS rank, chunk_no FROM code) WHERE rank <= 3",
    "associative_search": EDGES.rstrip()
    + f""", both_ways AS (SELECT repo, class_name AS node, used_class AS other FROM edges UNION ALL SELECT repo, used_class, class_name FROM edges),
hit AS (SELECT * FROM (SELECT repo, chunk_no, class_name, row_number() OVER (PARTITION BY repo ORDER BY chunk_no) AS rank FROM code WHERE chunk_type = 'whole_class') WHERE rank <= 10),
seed AS (SELECT DISTINCT repo, class_name AS node, 1.0::DOUBLE AS energy FROM hit),
h1 AS (SELECT repo, node, energy FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY round(energy, 9) DESC, node) AS rk FROM (SELECT repo, other AS node, sum(energy * 0.7) AS energy FROM both_ways JOIN seed USING (repo, node) GROUP BY ALL)) WHERE rk <= 10),
h2 AS (SELECT repo, node, energy FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY round(energy, 9) DESC, node) AS rk FROM (SELECT repo, other AS node, sum(energy * 0.7) AS energy FROM both_ways JOIN h1 USING (repo, node) GROUP BY ALL)) WHERE rk <= 10),
energy AS (SELECT repo, node AS class_name, round(sum(energy), 9) AS energy FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) ANTI JOIN seed USING (repo, node) GROUP BY ALL),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY energy DESC, class_name) AS rk FROM energy) WHERE rk <= 8),
found AS (SELECT * FROM (SELECT code.*, {TYPE_RANK} AS tr, near.energy, row_number() OVER (PARTITION BY repo, class_name ORDER BY {TYPE_RANK}, start_line NULLS FIRST, chunk_no) AS ck FROM code JOIN near USING (repo, class_name) ANTI JOIN hit USING (repo, chunk_no)) WHERE ck <= 3),
listed AS (SELECT repo, chunk_no, rank, 'hit' AS found_by FROM hit UNION ALL SELECT repo, chunk_no, row_number() OVER (PARTITION BY repo ORDER BY energy DESC, class_name, tr, start_line NULLS FIRST, chunk_no), 'graph' FROM found)
SELECT * FROM (SELECT repo, (row_number() OVER (PARTITION BY repo ORDER BY round(1::DOUBLE / (60 + rank), 12) DESC, found_by DESC, chunk_no))::INT AS position, chunk_no, round(1::DOUBLE / (60 + rank), 9) AS fused, found_by FROM listed) WHERE position <= 20""",
}

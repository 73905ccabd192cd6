"""Queries over chunks, components, scripts and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import corpus
from corvane.operators.nearest import nearest
from corvane.plans.sql import BLANKS, EDGES, LATEST, TYPE_RANK
from corvane.session import read_table


def _over_chunks(make):
    return lambda spark, folder: make(read_table(spark, folder, "code_chunk"))


def _usage(spark, folder):
    return corpus.script_usage(read_table(spark, folder, "mono_behaviour"), [read_table(spark, folder, t) for t in ("guid_map", "package_guid")])


def _nearest(spark, folder):
    vectors = read_table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


QUERIES = {
    "file_chunks_ordered": _over_chunks(corpus.file_listing),
    "index_status": _over_chunks(corpus.index_status),
    "find_implementations": _over_chunks(corpus.implementations),
    "dep_edges": _over_chunks(corpus.dependencies),
    "degree_topk": _over_chunks(lambda c: corpus.top_degrees(corpus.dependencies(c))),
    "asset_refs_by_guid": _usage,
    "asset_disambiguation": lambda spark, folder: corpus.ambiguous_classes(read_table(spark, folder, "guid_map")).withColumn("guids", F.array_join("guids", "|")),
    "knn_topk": _nearest,
}

ORACLE = {
    "file_chunks_ordered": LATEST + "SELECT repo, file_path, (row_number() OVER (PARTITION BY repo, file_path ORDER BY " + TYPE_RANK + ", start_line NULLS FIRST, chunk_no))::INTEGER AS position, chunk_no, chunk_type, start_line, end_line FROM latest",
    "index_status": LATEST + "SELECT repo, count(DISTINCT file_path) AS n_files, count(*) AS n_chunks, count(DISTINCT module) AS n_modules, max(indexed_at) AS last_indexed FROM latest GROUP BY repo",
    "find_implementations": LATEST
    + f"""SELECT DISTINCT * FROM (SELECT regexp_replace(trim(b, {BLANKS}), '<.*$', '') AS base_type, class_name, repo, module FROM (SELECT unnest(base_types) AS b, class_name, repo, module FROM latest WHERE class_name <> '')) WHERE base_type <> ''""",
    "dep_edges": EDGES + "SELECT * FROM edges",
    "degree_topk": EDGES
    + """, degree AS (SELECT repo, class_name, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT repo, class_name, 1 AS o, 0 AS i FROM edges UNION ALL SELECT repo, used_class, 0, 1 FROM edges) GROUP BY ALL)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY repo ORDER BY n_in DESC, n_out DESC, class_name))::INTEGER AS rank FROM degree) WHERE rank <= 10""",
    "asset_refs_by_guid": f"""
WITH used AS (SELECT lower(replace(trim(script_guid, {BLANKS}), '-', '')) AS script_guid, count(DISTINCT asset_path) AS n_assets, count(DISTINCT mb_no) AS n_components FROM mono_behaviour GROUP BY 1),
known AS (SELECT lower(replace(trim(guid, {BLANKS}), '-', '')) AS script_guid, script_path, class_name FROM (SELECT guid, script_path, class_name FROM guid_map UNION ALL SELECT guid, script_path, class_name FROM package_guid)),
one AS (SELECT script_guid, class_name FROM (SELECT *, row_number() OVER (PARTITION BY script_guid ORDER BY script_path NULLS FIRST, class_name NULLS FIRST) AS rn FROM known) WHERE rn = 1)
SELECT used.script_guid, class_name, n_assets, n_components FROM used LEFT JOIN one USING (script_guid) WHERE used.script_guid <> ''""",
    "asset_disambiguation": f"SELECT class_name, len(g)::INT AS n_guids, array_to_string(g, '|') AS guids FROM (SELECT class_name, list_sort(list_distinct(list(guid))) AS g FROM (SELECT class_name, lower(replace(trim(guid, {BLANKS}), '-', '')) AS guid FROM guid_map) WHERE class_name <> '' AND guid <> '' GROUP BY ALL) WHERE len(g) > 1",
    "knn_topk": """
SELECT query_id, rank::INTEGER AS rank, vec_id FROM (
  SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) ** 2, 9), v.vec_id) AS rank
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 10""",
}

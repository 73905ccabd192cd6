"""Queries p3_... and p5_...: orphan references and full hierarchies over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.forest import descendants, hierarchy
from corvane.operators.orphans import orphan_references, orphan_report
from corvane.session import read_table


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    parents = [read_table(spark, folder, "guid_map"), read_table(spark, folder, "package_guid")]
    return orphan_references(read_table(spark, folder, "mono_behaviour"), parents)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("mb_no").distinct()


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(_orphans(spark, folder), "mono_behaviour")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(read_table(spark, folder, "transform_info"), paths=False).select("asset_path", "file_id", "root_id", "depth")


def p5_paths(spark: SparkSession, folder: str) -> DataFrame:
    tree = hierarchy(read_table(spark, folder, "transform_info"))
    return tree.select("asset_path", "file_id", "root_id", "depth", F.array_join("path", "/").alias("path"))


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return descendants(hierarchy(read_table(spark, folder, "transform_info")))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants}

_BLANK = "' ' || chr(9) || chr(10) || chr(13)"

_P3 = f"""
WITH parent AS (
  SELECT lower(replace(trim(guid, {_BLANK}), '-', '')) AS k, added_at, removed_at FROM guid_map
  UNION ALL SELECT lower(replace(trim(guid, {_BLANK}), '-', '')), added_at, removed_at FROM package_guid),
ref AS (
  SELECT DISTINCT mb_no, seen_at, lower(replace(trim(script_guid, {_BLANK}), '-', '')) AS k FROM mono_behaviour WHERE script_guid IS NOT NULL),
orphan AS (
  SELECT mb_no, seen_at, k FROM ref WHERE NOT regexp_full_match(k, '0*') AND NOT EXISTS (
    SELECT 1 FROM parent WHERE parent.k = ref.k AND (added_at IS NULL OR added_at <= seen_at) AND (removed_at IS NULL OR removed_at > seen_at)))
"""

_P5 = f"""
WITH RECURSIVE latest AS (
  SELECT asset_path, file_id, trim(coalesce(parent_id, ''), {_BLANK}) AS p, children_ids FROM (
    SELECT *, row_number() OVER (PARTITION BY asset_path, file_id ORDER BY seen_at DESC, parent_id DESC NULLS LAST, children_ids DESC NULLS LAST) AS rn FROM transform_info)
  WHERE rn = 1),
lister AS (SELECT asset_path, c AS file_id, min(f) AS p FROM (SELECT asset_path, file_id AS f, unnest(children_ids) AS c FROM latest) GROUP BY ALL),
link AS (
  SELECT l.asset_path, l.file_id, k.file_id AS p FROM (
    SELECT latest.asset_path, latest.file_id, CASE WHEN latest.p <> '' THEN latest.p ELSE lister.p END AS p
    FROM latest LEFT JOIN lister ON latest.asset_path = lister.asset_path AND latest.file_id = lister.file_id) l
  LEFT JOIN latest k ON k.asset_path = l.asset_path AND k.file_id = l.p AND l.p <> '0'),
tree AS (
  SELECT asset_path, file_id, file_id AS root_id, 0 AS depth, file_id AS path FROM link WHERE p IS NULL
  UNION ALL
  SELECT link.asset_path, link.file_id, tree.root_id, tree.depth + 1, tree.path || '/' || link.file_id
  FROM tree JOIN link ON link.asset_path = tree.asset_path AND link.p = tree.file_id),
full_tree AS (
  SELECT asset_path, file_id, root_id, depth, path FROM tree
  UNION ALL
  SELECT asset_path, file_id, '', -1, '' FROM link l WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.asset_path = l.asset_path AND t.file_id = l.file_id))
"""

ORACLE = {
    "p3_found": _P3 + "SELECT DISTINCT mb_no FROM orphan",
    "p3_report": _P3
    + """, judged AS (
  SELECT o.mb_no, o.seen_at, CASE WHEN NOT EXISTS (SELECT 1 FROM parent p WHERE p.k = o.k AND (added_at IS NULL OR removed_at IS NULL OR added_at < removed_at)) THEN 'missing'
    WHEN o.seen_at IS NULL THEN 'undated'
    WHEN EXISTS (SELECT 1 FROM parent p WHERE p.k = o.k AND (added_at IS NULL OR added_at <= o.seen_at) AND (added_at IS NULL OR removed_at IS NULL OR added_at < removed_at)) THEN 'deleted' ELSE 'late' END AS status
  FROM orphan o)
SELECT 'mono_behaviour' AS ref_table, strftime(seen_at, '%Y-%m') AS period, status, count(DISTINCT mb_no) AS n_refs FROM judged GROUP BY ALL""",
    "p5_found": _P5 + "SELECT asset_path, file_id, root_id, depth FROM full_tree",
    "p5_paths": _P5 + "SELECT asset_path, file_id, root_id, depth, path FROM full_tree",
    "p5_descendants": _P5
    + """SELECT asset_path, parts[i] AS file_id, file_id AS descendant_id, (len(parts) - i)::INTEGER AS distance
FROM (SELECT asset_path, file_id, parts, unnest(range(1, len(parts))) AS i FROM (SELECT asset_path, file_id, string_split(path, '/') AS parts FROM full_tree WHERE depth > 0))""",
}

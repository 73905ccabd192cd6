"""Queries of scans, folders, the upkeep of an index and reads by key, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import bindings, corpus, dependencies, graph, index, projections, retrieval
from corvane.operators.nearest import nearest
from corvane.plans.graphs import CHANGED_SINCE
from corvane.plans.sql import EDGES, LATEST, quoted
from corvane.session import cut_lineage, read_table
from corvane.sources import trees

ALIASES, PREFIXES = {"ferrule": "main", "weldview": "view"}, ["Ferrule.", "Store.", "Vision."]
EXCLUDES = ["*.min.js", "*.gen.ts", "node_modules/", "obj/", "*_gen.go", "third_party"]


def _chunks(spark, folder):
    return read_table(spark, folder, "code_chunk")


def _files(spark, folder):
    return corpus.latest_chunks(_chunks(spark, folder)).select("repo", F.col("file_path").alias("rel_path")).where("rel_path is not null").distinct()


def kept_files(spark, folder):
    """The files that no exclude pattern hits, with their language."""
    kept = _files(spark, folder).where(~trees.Excludes.of(EXCLUDES).hit(F.col("rel_path")))
    return kept.withColumn("language", trees.language_of_path(F.col("rel_path")))


def source_dir_assign(spark, folder):
    """Every file goes to the stated folder of its repository that fits best: its first folder, and that of its language."""
    files = _files(spark, folder)
    first = files.where("rel_path like '%/%'").select("repo", F.substring_index("rel_path", "/", 1).alias("folder"), F.array(F.lit("cs")).alias("endings"), F.lit(2).alias("place")).distinct()
    found = trees.source_folders(files).where("language in ('csharp', 'python')").select("repo", "folder", F.when(F.col("language") == "csharp", F.array(F.lit("cs"))).otherwise(F.array(F.lit("py"))).alias("endings"), F.lit(1).alias("place"))
    return trees.assign_folders(files, first.unionByName(found.groupBy("repo", "folder").agg(F.min("endings").alias("endings"), F.min("place").alias("place"))))


def _sources(spark, folder, moment):
    """Whole files as they were known at a moment, by the version of the chunk that was latest then."""
    rows = _chunks(spark, folder).where(f"lower(trim(chunk_type)) = 'whole_class' and indexed_at is not null and indexed_at <= timestamp_ntz'{moment}'")
    return corpus.latest_chunks(rows).groupBy("repo", "file_path").agg(F.max(F.struct("indexed_at", "source")).alias("__l")).select("repo", "file_path", F.col("__l.source").alias("source"), F.col("__l.indexed_at").alias("modified_at"))


def index_run_counts(spark, folder):
    before, after = (_sources(spark, folder, m) for m in (CHANGED_SINCE, "2100-01-01"))
    gone = after.where(F.length("file_path") % 10 != 0)  # some files are taken away
    return index.run_counts(index.Index(before, before.select("repo", "file_path", "modified_at"), before), gone)


def index_update(spark, folder):
    """Chunks by file after an update of the index of an earlier state."""
    before, after = (_sources(spark, folder, m) for m in (CHANGED_SINCE, "2100-01-01"))
    made = index.update_index(index.full_index(cut_lineage(before)), cut_lineage(after))
    return made.chunks.groupBy("repo", "file_path").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("end_line").alias("last_line"))


def staleness_count(spark, folder):
    files = _chunks(spark, folder).select("repo", F.col("indexed_at").alias("modified_at"))
    indexed = files.select("repo").distinct().withColumn("indexed_at", F.lit(CHANGED_SINCE).cast("timestamp_ntz"))
    return trees.newer_than(files, indexed)


def distance_profile(spark, folder):
    vectors = read_table(spark, folder, "embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    near = nearest(vectors, asked, k=5, distance="distance")
    made = retrieval.profile(near, ["rank"])
    return made.select("rank", "n", *(F.round(c, 6).alias(c) for c in ("least", "p25", "p50", "p75", "most")))


def community_modules(spark, folder):
    chunks = _chunks(spark, folder)
    labels = graph.communities(cut_lineage(corpus.dependencies(chunks)))
    made = dependencies.module_distribution(labels, dependencies.nodes(dependencies.references_of_files(chunks)))
    return made.withColumn("first_classes", F.array_join("first_classes", "|"))


def analyze_ranks(spark, folder, k=20):
    """The classes of highest rank of each repository with their degrees and community (a top-k report)."""
    edges = cut_lineage(corpus.dependencies(_chunks(spark, folder)))
    ranks = graph.page_rank(edges, tolerance=1e-10).withColumn("page_rank", F.round("page_rank", 6))
    all_in = ranks.join(corpus.degrees(edges), ["repo", "class_name"]).join(graph.communities(edges), ["repo", "class_name"])
    order = F.row_number().over(corpus.W.partitionBy("repo").orderBy(F.desc("page_rank"), "class_name"))
    return all_in.withColumn("rank", order).where(F.col("rank") <= k)


def chunks_by_key(spark, folder):
    """The chunks of stated numbers (those divisible by 50)."""
    rows = corpus.latest_chunks(_chunks(spark, folder))
    asked = _chunks(spark, folder).where("chunk_no % 50 = 0").select("chunk_no").distinct()
    return rows.join(asked, "chunk_no", "left_semi").select("chunk_no", "repo", "file_path", "chunk_type", F.md5("source").alias("source_hash"))


def asset_repos(spark, folder):
    """Which repositories hold chunks of assets at all, and their modules."""
    rows = corpus.latest_chunks(_chunks(spark, folder))
    return rows.groupBy("repo").agg(F.bool_or(F.col("chunk_type").isin("prefab_summary", "gameobject", "scriptable_object")).alias("has_assets"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("module") != "", F.col("module")))), "|").alias("modules"))


def entity_context(spark, folder):
    """What the classes of packages stand for among the chunks, and the base types of the project's classes."""
    chunks = _chunks(spark, folder)
    asked = corpus.implementations(chunks).select(F.col("base_type").alias("name")).unionByName(read_table(spark, folder, "guid_map").select(F.col("class_name").alias("name")))
    return corpus.entity_chunks(chunks, asked)


def richest_types(spark, folder):
    return corpus.richest_types(_chunks(spark, folder)).withColumn("base_types", F.array_join("base_types", "|"))


def chunk_projections(spark, folder):
    """What is shown of each chunk: metadata kept beside its vector (as md5), kind of file, stripped namespace, age and more."""
    rows = corpus.latest_chunks(_chunks(spark, folder))
    c = F.col
    line = F.split(F.regexp_replace("source", r"\r\n?", "\n"), "\n", -1)[0]
    key = dependencies.node_key(c("class_name"), F.coalesce("namespace", F.lit("")), c("module"), c("file_path"))
    age = F.unix_timestamp(F.lit("2030-01-01").cast("timestamp_ntz")) - F.unix_timestamp("indexed_at")
    return rows.select(
        "chunk_no", projections.aliased(c("repo"), ALIASES).alias("alias"), projections.asset_kind(c("file_path")).alias("kind"), projections.without_prefixes(c("namespace"), PREFIXES).alias("namespace"),
        projections.matches_pattern(c("file_path"), "*.cs").alias("is_cs"), F.md5(projections.trimmed_line(line, 40)).alias("line_hash"), dependencies.class_of_key(key).alias("key_class"), projections.age_text(age).alias("age"),
        F.md5(F.concat_ws("|", F.coalesce("method_name", F.lit("")), F.array_join("base_types", ","), F.substring("source", 1, projections.MOST_CHARS))).alias("stored_hash"),
    )


def guid_reference_names(spark, folder):
    """Which scripts assets refer to, by name where the project has the guid."""
    refs = read_table(spark, folder, "mono_behaviour").where("script_guid is not null").select(F.col("asset_path").alias("name"), F.concat(F.lit("GUID:"), F.trim("script_guid")).alias("reference"))
    return bindings.assembly_edges(refs, read_table(spark, folder, "guid_map").select("guid", F.col("class_name").alias("name")))


QUERIES = {
    "chunk_projections": chunk_projections,
    "guid_reference_names": guid_reference_names,
    "entity_context": entity_context,
    "richest_types": richest_types,
    "kept_files": kept_files,
    "lang_autodetect": lambda spark, folder: trees.source_folders(_files(spark, folder)),
    "source_dir_assign": source_dir_assign,
    "enclosing_types": lambda spark, folder: corpus.enclosing_types(_chunks(spark, folder)),
    "index_run_counts": index_run_counts,
    "index_update": index_update,
    "staleness_count": staleness_count,
    "distance_profile": distance_profile,
    "community_modules": community_modules,
    "analyze_ranks": analyze_ranks,
    "chunks_by_key": chunks_by_key,
    "asset_repos": asset_repos,
}

_FILES = LATEST.rstrip() + ", f AS (SELECT DISTINCT repo, file_path AS rel_path FROM latest WHERE file_path IS NOT NULL)"
_LANGUAGE = "CASE " + " ".join(f"WHEN lower(regexp_extract(rel_path, '\\.([^./]+)$', 1)) IN ({', '.join(map(quoted, e))}) THEN '{n}'" for n, e in reversed(trees.LANGUAGE_ENDINGS.items())) + " END"
_SKIP = ", ".join(map(quoted, trees.SKIPPED_FOLDERS))
_FOLDERS = f""", lang AS (SELECT repo, language, count(*) AS n_files, string_split(min(rel_path), '/') AS a, string_split(max(rel_path), '/') AS b FROM (SELECT *, {_LANGUAGE} AS language FROM f) WHERE language IS NOT NULL AND NOT list_has_any(string_split(rel_path, '/')[:-2], [{_SKIP}]) GROUP BY ALL),
found AS (SELECT repo, language, n_files, array_to_string(a[1:least(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])), len(a) - 1, len(b) - 1)], '/') AS folder FROM lang WHERE n_files >= 2)"""
_AT = """SELECT repo, file_path, max(indexed_at) AS t FROM (SELECT *, row_number() OVER (PARTITION BY chunk_no ORDER BY indexed_at DESC, repo DESC NULLS LAST, file_path DESC NULLS LAST) AS rn FROM (
  SELECT chunk_no, repo, regexp_replace(replace(file_path, '\\', '/'), '^(\\./+)+', '') AS file_path, indexed_at FROM code_chunk WHERE chunk_no IS NOT NULL AND lower(trim(chunk_type, ' ')) = 'whole_class' AND indexed_at <= TIMESTAMP '{}')) WHERE rn = 1 GROUP BY ALL"""

_STRIP = "namespace"
for _p in PREFIXES:
    _STRIP = f"CASE WHEN starts_with({_STRIP}, {quoted(_p)}) THEN substr({_STRIP}, {len(_p) + 1}) ELSE {_STRIP} END"
_FIRST = "regexp_replace(string_split(replace(replace(source, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))[1], '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"

ORACLE = {
    "chunk_projections": LATEST + f"""SELECT chunk_no, CASE repo {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items())} ELSE repo END AS alias,
CASE WHEN lower(file_path) LIKE '%.prefab' THEN 'prefab' WHEN lower(file_path) LIKE '%.unity' THEN 'scene' ELSE 'other' END AS kind, {_STRIP} AS namespace, ends_with(file_path, '.cs') AS is_cs,
md5(CASE WHEN length({_FIRST}) > 40 THEN left({_FIRST}, 40) || '...' ELSE {_FIRST} END) AS line_hash,
CASE WHEN coalesce(namespace, '') <> '' THEN string_split(class_name, '.')[-1] ELSE class_name END AS key_class,
CASE WHEN s >= 3600 THEN (s // 3600) || 'h' ELSE (s // 60) || 'm' END AS age, md5(concat_ws('|', coalesce(method_name, ''), array_to_string(base_types, ','), left(source, 5000))) AS stored_hash
FROM (SELECT *, (epoch(TIMESTAMP '2030-01-01') - floor(epoch(indexed_at)))::BIGINT AS s FROM latest)""",
    "guid_reference_names": """WITH k AS (SELECT lower(guid) AS g, min(class_name) AS name FROM guid_map WHERE guid <> '' GROUP BY 1),
r AS (SELECT asset_path AS name, trim('GUID:' || trim(script_guid, ' '), ' ' || chr(9) || chr(10) || chr(13)) AS reference FROM mono_behaviour WHERE script_guid IS NOT NULL),
x AS (SELECT *, lower(regexp_extract(reference, '^GUID:\\s*(\\w+)$', 1)) AS g FROM r)
SELECT DISTINCT x.name, CASE WHEN x.g = '' THEN reference ELSE coalesce(k.name, '[' || left(x.g, 8) || '...]') END AS reference FROM x LEFT JOIN k ON k.g = x.g""",
    "richest_types": EDGES.rstrip() + """ SELECT repo, class_name, greatest(coalesce(len(base_types), 0), 0)::INT AS n_bases, coalesce(array_to_string(base_types, '|'), '') AS base_types FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, class_name ORDER BY coalesce(len(base_types), 0) DESC, chunk_no) AS rk FROM code) WHERE rk = 1""",
    "entity_context": LATEST + """, a AS (SELECT DISTINCT class_name AS name FROM guid_map UNION SELECT regexp_replace(trim(b, ' ' || chr(9) || chr(10) || chr(13)), '<.*$', '') FROM (SELECT unnest(base_types) AS b, class_name FROM latest WHERE class_name <> '')),
h AS (SELECT chunk_no, class_name AS name, 0 AS way FROM latest UNION ALL SELECT chunk_no, method_name, 1 FROM latest UNION ALL SELECT chunk_no, unnest(base_types), 2 FROM latest)
SELECT name, chunk_no, ['class', 'method', 'base'][min(way) + 1] AS matched FROM h SEMI JOIN a USING (name) WHERE name <> '' GROUP BY name, chunk_no""",
    "index_run_counts": f"""WITH a AS ({_AT.format(CHANGED_SINCE)}), b AS (SELECT * FROM ({_AT.format('2100-01-01')}) WHERE length(file_path) % 10 <> 0),
s AS (SELECT coalesce(a.repo, b.repo) AS repo, CASE WHEN a.t IS NULL THEN 'new' WHEN b.t IS NULL THEN 'removed' WHEN a.t = b.t THEN 'unchanged' ELSE 'changed' END AS s FROM a FULL JOIN b ON a.repo = b.repo AND a.file_path = b.file_path)
SELECT repo, count(*) FILTER (s <> 'removed') AS n_scanned, count(*) FILTER (s = 'new') AS n_new, count(*) FILTER (s = 'changed') AS n_changed, count(*) FILTER (s = 'unchanged') AS n_unchanged, count(*) FILTER (s = 'removed') AS n_removed FROM s GROUP BY repo""",
    "kept_files": _FILES + f""" SELECT repo, rel_path, {_LANGUAGE} AS language FROM f WHERE NOT (lower(string_split(rel_path, '/')[-1]) LIKE '%.min.js' OR lower(string_split(rel_path, '/')[-1]) LIKE '%.gen.ts'
 OR list_has_any(string_split(rel_path, '/')[:-2], ['node_modules', 'obj']) OR regexp_matches(string_split(rel_path, '/')[-1], '^.*_gen\\.go$') OR contains(rel_path, 'third_party'))""",
    "lang_autodetect": _FILES + _FOLDERS + " SELECT repo, language, n_files, folder FROM found",
    "source_dir_assign": _FILES + _FOLDERS + """, d AS (SELECT repo, folder, e, min(place) AS place FROM (SELECT DISTINCT repo, string_split(rel_path, '/')[1] AS folder, 'cs' AS e, 2 AS place FROM f WHERE contains(rel_path, '/')
  UNION ALL SELECT repo, folder, min(CASE WHEN language = 'csharp' THEN 'cs' ELSE 'py' END), 1 FROM found WHERE language IN ('csharp', 'python') GROUP BY repo, folder) GROUP BY repo, folder, e, place),
m AS (SELECT f.repo, f.rel_path, d.folder, row_number() OVER (PARTITION BY f.repo, f.rel_path ORDER BY (lower(regexp_extract(f.rel_path, '\\.([^./]+)$', 1)) <> e)::INT, place, d.folder) AS rn FROM f JOIN d ON d.repo = f.repo AND (d.folder = '' OR starts_with(f.rel_path, d.folder || '/')))
SELECT f.repo, f.rel_path, m.folder FROM f LEFT JOIN m ON m.repo = f.repo AND m.rel_path = f.rel_path AND m.rn = 1""",
    "enclosing_types": LATEST + """, t AS (SELECT repo, file_path, chunk_no AS outer_no, class_name AS outer_class, start_line AS f, end_line AS e FROM latest WHERE chunk_type IN ('whole_class', 'class_summary') AND start_line IS NOT NULL AND end_line IS NOT NULL)
SELECT chunk_no, outer_no, outer_class FROM (SELECT l.chunk_no, t.outer_no, t.outer_class, row_number() OVER (PARTITION BY l.chunk_no ORDER BY t.e - t.f, t.outer_no) AS rn FROM latest l JOIN t ON t.repo = l.repo AND t.file_path = l.file_path AND t.f <= l.start_line AND t.e >= l.end_line AND t.outer_no <> l.chunk_no) WHERE rn = 1""",
    "staleness_count": f"SELECT repo, count(*) FILTER (indexed_at > TIMESTAMP '{CHANGED_SINCE}') AS n_newer, coalesce(epoch(max(indexed_at)) - epoch(TIMESTAMP '{CHANGED_SINCE}') > 1800, false) AS stale FROM code_chunk WHERE repo IS NOT NULL GROUP BY repo",
    "distance_profile": """WITH h AS (SELECT * FROM (SELECT q.vec_id AS q, list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) ** 2 AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) ** 2, 9), v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 5)
SELECT rank::INT AS rank, count(*) AS n, round(min(d), 6) AS least, round(quantile_cont(d, 0.25), 6) AS p25, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.75), 6) AS p75, round(max(d), 6) AS most FROM h GROUP BY ALL""",
    "chunks_by_key": LATEST + "SELECT chunk_no, repo, file_path, chunk_type, md5(source) AS source_hash FROM latest WHERE chunk_no % 50 = 0",
    "asset_repos": LATEST + "SELECT repo, coalesce(bool_or(chunk_type IN ('prefab_summary', 'gameobject', 'scriptable_object')), false) AS has_assets, coalesce(array_to_string(list_sort(list_distinct(list(module) FILTER (module <> ''))), '|'), '') AS modules FROM latest GROUP BY repo",
}

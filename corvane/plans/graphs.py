"""Queries of graphs, search, references, upkeep and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.keys import normal_guid
from corvane.operators import corpus, graph, parsing, references, retrieval, sections, snapshots
from corvane.operators.nearest import nearest
from corvane.operators.parsing import definitions
from corvane.plans.sql import BLANKS, EDGES, LINED, quoted
from corvane.session import cut_lineage, read_table
from corvane.streaming import events as streams

#: Rounds of the SQL, by which the results have settled; the operators stop by themselves.
PAGE_RANK_ROUNDS, COMMUNITY_ROUNDS = 90, 40

#: The two moments between which the table of scripts is compared, and the one at which chunks count as changed.
BEFORE, AFTER, CHANGED_SINCE = "2024-03-01", "2024-09-01", "2024-06-01"


def _edges(spark, folder):
    return cut_lineage(corpus.dependencies(read_table(spark, folder, "code_chunk")))


def _activation(spark, folder):
    edges = _edges(spark, folder)
    return graph.spread_activation(edges, corpus.top_degrees(edges, 3).select("repo", "class_name"))


def _probes(spark, folder, sign=1):
    asked = read_table(spark, folder, "embeddings").where(F.col("vec_id") % 50 == 0)
    return asked.withColumn("embedding", F.transform("embedding", lambda x: x * sign))


def _thresholds(spark, folder):
    vectors = read_table(spark, folder, "embeddings")
    first = [nearest(vectors, _probes(spark, folder, sign), k=1, distance="distance") for sign in (1, -1)]
    return retrieval.calibrate(*first)


def calibration_thresholds(spark, folder):
    return _thresholds(spark, folder).select(*(F.round(c, 6).alias(c) for c in ("high", "medium", "low")))


def confidence_label_score(spark, folder):
    """The ten nearest of each query with label and score; the thresholds are one row."""
    t = _thresholds(spark, folder).first()
    high, medium, low = (F.lit(t[c]) for c in ("high", "medium", "low"))
    vectors = read_table(spark, folder, "embeddings")
    d = F.col("d")
    hits = nearest(vectors, _probes(spark, folder), distance="d")
    return hits.select("query_id", "vec_id", retrieval.confidence(F.round(d, 9), F.round(high, 9), F.round(medium, 9), F.round(low, 9)).alias("label"), F.round(retrieval.score(d, high, medium, low), 3).alias("score"))


def rrf_fusion(spark, folder):
    """Neighbours of each query fused with those of its nearest neighbour."""
    vectors = read_table(spark, folder, "embeddings")
    direct = cut_lineage(nearest(vectors, _probes(spark, folder)))
    first = direct.where("rank = 1").join(vectors, "vec_id").select(F.col("query_id").alias("vec_id"), "embedding")
    fused = retrieval.fuse_ranks([direct, nearest(vectors, first)], ["query_id", "vec_id"])
    return fused.withColumn("fused", F.round("fused", 9))


def _references(spark, folder):
    return references.class_lines(read_table(spark, folder, "code_chunk"))


def reference_counts(spark, folder):
    return _references(spark, folder).groupBy("repo", "symbol").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("file_path").alias("n_files"))


def reference_tags(spark, folder):
    return references.class_references(read_table(spark, folder, "code_chunk"))


def definition_counts(spark, folder):
    return definitions(read_table(spark, folder, "code_chunk")).groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("name").alias("n_names"))


def file_chunk_counts(spark, folder):
    """What the chunkers make of the sources that are whole files, and of documents with a path."""
    whole = corpus.latest_chunks(read_table(spark, folder, "code_chunk")).where("start_line = 1 and chunk_type in ('whole_class', 'template', 'json_key', 'yaml_key', 'css_rule', 'md_section')").select("repo", "file_path", "source")
    texts = read_table(spark, folder, "documents").where("rel_path is not null").select("repo", F.col("rel_path").alias("file_path"), F.col("text").alias("source"))
    made = parsing.file_chunks(whole.unionByName(texts))
    ending = F.lower(F.regexp_extract("file_path", r"(\.[^./]+)$", 1))
    return made.groupBy(ending.alias("ending"), "chunk_type").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("doc_comment") != "").alias("n_documented"))


def _scripts_at(spark, folder, moment):
    rows = read_table(spark, folder, "guid_map").where(f"(added_at is null or added_at <= timestamp_ntz'{moment}') and (removed_at is null or removed_at > timestamp_ntz'{moment}')")
    return rows.groupBy(normal_guid(F.col("guid")).alias("guid")).agg(F.max("script_path").alias("script_path"))


def manifest_diff(spark, folder):
    return snapshots.manifest_diff(_scripts_at(spark, folder, BEFORE), _scripts_at(spark, folder, AFTER), "guid", "script_path")


def incremental_replace(spark, folder):
    """Chunks of each file, with the counts of files that changed replaced by those of what came since."""
    chunks = read_table(spark, folder, "code_chunk")
    since = F.coalesce(F.col("indexed_at") >= F.lit(CHANGED_SINCE).cast("timestamp_ntz"), F.lit(False))  # without a time: not since
    count = lambda rows: rows.groupBy("repo", "file_path").agg(F.count_distinct("chunk_no").alias("n_chunks"), F.max("indexed_at").alias("last_indexed"))
    return snapshots.replace_keys(count(chunks.where(~since)), count(chunks.where(since)), ["repo", "file_path"])


def md_sections(spark, folder):
    made = sections.heading_sections(read_table(spark, folder, "documents"))
    return made.select("doc_id", "position", "level", "title", F.length("section").alias("n_chars"))


def _deliveries(spark, folder):
    """The events in deliveries of ten days each, every seventh event two deliveries late."""
    events = read_table(spark, folder, "events")
    number = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)) + F.when(F.col("event_id") % 7 == 0, 2).otherwise(0)
    return streams.event_stream(spark, streams.deliver(events, number, 5))


def stream_window_counts(spark, folder):
    made = streams.drain_updates(streams.window_counts(_deliveries(spark, folder)), ["window_start", "event_type"])
    return made.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", F.round("total", 4).alias("total"))


def stream_dedup(spark, folder):
    made = streams.drain_rows(streams.without_repeats(_deliveries(spark, folder)))
    return made.select("event_id", "user_id", "event_type")


QUERIES = {
    "spread_activation": lambda spark, folder: _activation(spark, folder).withColumn("energy", F.round("energy", 6)),
    "pagerank": lambda spark, folder: graph.page_rank(_edges(spark, folder), tolerance=1e-10).withColumn("page_rank", F.round("page_rank", 6)),
    "communities": lambda spark, folder: graph.communities(_edges(spark, folder)),
    "calibration_thresholds": calibration_thresholds,
    "confidence_label_score": confidence_label_score,
    "rrf_fusion": rrf_fusion,
    "find_references": _references,
    "reference_counts": reference_counts,
    "reference_tags": reference_tags,
    "definition_counts": definition_counts,
    "file_chunk_counts": file_chunk_counts,
    "manifest_diff": manifest_diff,
    "incremental_replace": incremental_replace,
    "md_sections": md_sections,
    "stream_window_counts": stream_window_counts,
    "stream_dedup": stream_dedup,
}

_BOTH = EDGES.rstrip() + """, both_ways AS MATERIALIZED (
  SELECT repo, class_name AS node, used_class AS other FROM edges UNION ALL SELECT repo, used_class, class_name FROM edges)
"""


def _rounds(start: str, step: str, n: int) -> str:
    """CTEs r0 to rn, each made by step from the one before it."""
    return f", r0 AS MATERIALIZED ({start})" + "".join(f", r{i} AS MATERIALIZED ({step.format(last=f'r{i - 1}', round=i - 1)})" for i in range(1, n + 1))


_HOP = """SELECT repo, node, energy FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY round(energy, 9) DESC, node) AS rk FROM (
  SELECT repo, other AS node, sum(energy * 0.7) AS energy FROM both_ways JOIN {last} USING (repo, node) GROUP BY ALL)) WHERE rk <= 10"""
_SEEDS = """SELECT repo, class_name AS node, 1.0::DOUBLE AS energy FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n_in DESC, n_out DESC, class_name) AS rk FROM (
  SELECT repo, class_name, sum(o) AS n_out, sum(i) AS n_in FROM (SELECT repo, class_name, 1 AS o, 0 AS i FROM edges UNION ALL SELECT repo, used_class, 0, 1 FROM edges) GROUP BY ALL)) WHERE rk <= 3"""
_RANK_START = """SELECT repo, node, n_out, count(*) OVER (PARTITION BY repo) AS n, 1.0::DOUBLE / count(*) OVER (PARTITION BY repo) AS held FROM (
  SELECT repo, node, sum(o) AS n_out FROM (SELECT repo, class_name AS node, 1 AS o FROM edges UNION ALL SELECT repo, used_class, 0 FROM edges) GROUP BY ALL)"""
_RANK_STEP = """SELECT s.repo, s.node, s.n_out, s.n, 0.15::DOUBLE / s.n + 0.85::DOUBLE * (coalesce(g.got, 0) + coalesce(d.idle, 0) / s.n) AS held FROM {last} s
  LEFT JOIN (SELECT e.repo, e.used_class AS node, sum(x.held / x.n_out) AS got FROM edges e JOIN {last} x ON x.repo = e.repo AND x.node = e.class_name GROUP BY ALL) g USING (repo, node)
  LEFT JOIN (SELECT repo, sum(held) AS idle FROM {last} WHERE n_out = 0 GROUP BY ALL) d ON d.repo = s.repo"""
_LABEL_STEP = """SELECT s.repo, s.node, CASE WHEN substr(md5(s.node || '/{round}'), 1, 1) < '8' THEN v.want ELSE s.label END AS label FROM {last} s JOIN (
  SELECT repo, node, CASE WHEN bool_or(label = own AND c = top) THEN any_value(own) ELSE min(label) FILTER (c = top) END AS want FROM (SELECT *, max(c) OVER (PARTITION BY repo, node) AS top FROM (
    SELECT b.repo, b.node, x.label, o.label AS own, count(*) AS c FROM both_ways b JOIN {last} x ON x.repo = b.repo AND x.node = b.other JOIN {last} o ON o.repo = b.repo AND o.node = b.node GROUP BY ALL))
  GROUP BY repo, node) v ON v.repo = s.repo AND v.node = s.node"""

_KNN = """WITH probe AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_transform(embedding::DOUBLE[], lambda x: -x) AS m FROM embeddings WHERE vec_id % 50 = 0),
hit AS MATERIALIZED (SELECT * FROM (SELECT p.vec_id AS query_id, v.vec_id, list_distance(p.e, v.embedding::DOUBLE[]) ** 2 AS d, row_number() OVER (PARTITION BY p.vec_id ORDER BY round(list_distance(p.e, v.embedding::DOUBLE[]) ** 2, 9), v.vec_id) AS rank
  FROM probe p JOIN embeddings v ON p.vec_id <> v.vec_id) WHERE rank <= 10),
miss AS (SELECT p.vec_id, min(list_distance(p.m, v.embedding::DOUBLE[]) ** 2) AS d FROM probe p JOIN embeddings v ON p.vec_id <> v.vec_id GROUP BY ALL),
t AS (SELECT (SELECT quantile_cont(d, 0.25) FROM hit WHERE rank = 1) AS h, (SELECT quantile_cont(d, 0.75) FROM hit WHERE rank = 1) AS m, (SELECT quantile_cont(d, 0.25) FROM miss) AS l)
"""


_REFERENCES = EDGES.rstrip() + f""", symbols AS (SELECT repo, used_class AS symbol FROM known),
lines AS (SELECT repo, file_path, start_line, parts[i] AS line, start_line + i - 1 AS line_no FROM (
  SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT repo, file_path, start_line, string_split({LINED.format('source')}, chr(10)) AS parts FROM latest WHERE start_line IS NOT NULL))),
line_names AS (SELECT repo, file_path, line_no::INTEGER AS line_no, unnest(list_distinct(regexp_extract_all(line, {quoted(corpus.TYPE_NAME)}))) AS symbol FROM lines),
found AS (SELECT DISTINCT repo, symbol, file_path, line_no FROM line_names SEMI JOIN symbols USING (repo, symbol))
"""

_AT = f"SELECT lower(replace(trim(guid, {BLANKS}), '-', '')) AS guid, max(script_path) AS p FROM guid_map WHERE guid IS NOT NULL AND (added_at IS NULL OR added_at <= TIMESTAMP '{{m}}') AND (removed_at IS NULL OR removed_at > TIMESTAMP '{{m}}') GROUP BY 1"
_COUNT = "SELECT repo, file_path, count(DISTINCT chunk_no) AS n_chunks, max(indexed_at) AS last_indexed FROM code_chunk WHERE coalesce(indexed_at >= TIMESTAMP '" + CHANGED_SINCE + "', false) = {} GROUP BY ALL"

#: Each event with the watermark that judges it: an hour before the latest event of all deliveries but the last one before.
#: (Spark judges what is late by the watermark at the end of the batch before the last.)
_DELIVERED = """WITH batched AS (SELECT *, least(floor((day(ts) - 1) / 10), 2)::INT + 2 * (event_id % 7 = 0)::INT AS batch FROM events WHERE ts IS NOT NULL),
latest AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 1 HOUR AS mark FROM batched GROUP BY batch),
marked AS (SELECT batched.*, date_trunc('millisecond', mark) AS mark FROM batched JOIN latest USING (batch))
"""

ORACLE = {
    "spread_activation": _BOTH + _rounds(_SEEDS, _HOP, 2) + "SELECT repo, node AS class_name, round(sum(energy), 6) AS energy FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) ANTI JOIN r0 USING (repo, node) GROUP BY ALL",
    "pagerank": EDGES.rstrip() + _rounds(_RANK_START, _RANK_STEP, PAGE_RANK_ROUNDS) + f"SELECT repo, node AS class_name, round(held, 6) AS page_rank FROM r{PAGE_RANK_ROUNDS}",
    "communities": _BOTH + _rounds("SELECT DISTINCT repo, node, node AS label FROM both_ways", _LABEL_STEP, COMMUNITY_ROUNDS) + f"SELECT repo, node AS class_name, label AS community FROM r{COMMUNITY_ROUNDS}",
    "calibration_thresholds": _KNN + "SELECT round(h, 6) AS high, round(m, 6) AS medium, round(l, 6) AS low FROM t",
    "confidence_label_score": _KNN + """SELECT query_id, vec_id, CASE WHEN round(d, 9) < round(h, 9) THEN 'HIGH' WHEN round(d, 9) < round(m, 9) THEN 'MEDIUM' WHEN round(d, 9) < round(l, 9) THEN 'LOW' ELSE 'NO MATCH' END AS label,
round(CASE WHEN d <= 0 THEN 100 WHEN d <= h THEN 100 - 15 * d / h WHEN d <= m THEN 85 - 30 * (CASE WHEN m > h THEN (d - h) / (m - h) ELSE 0 END)
  WHEN d <= l THEN 55 - 40 * (CASE WHEN l > m THEN (d - m) / (l - m) ELSE 0 END) WHEN d <= 1.2::DOUBLE * l THEN 15 - 15 * (d - l) / (0.2::DOUBLE * l) ELSE 0 END, 3) AS score FROM hit, t""",
    "rrf_fusion": _KNN + """, again AS (SELECT * FROM (SELECT h.query_id, v.vec_id, row_number() OVER (PARTITION BY h.query_id ORDER BY round(list_distance(n.embedding::DOUBLE[], v.embedding::DOUBLE[]) ** 2, 9), v.vec_id) AS rank
  FROM hit h JOIN embeddings n ON n.vec_id = h.vec_id JOIN embeddings v ON v.vec_id <> h.query_id WHERE h.rank = 1) WHERE rank <= 10)
SELECT query_id, vec_id, round(sum(1::DOUBLE / (60 + rank)), 9) AS fused FROM (SELECT query_id, vec_id, rank FROM hit UNION ALL SELECT query_id, vec_id, rank FROM again) GROUP BY ALL""",
    "find_references": _REFERENCES + "SELECT * FROM found",
    "reference_counts": _REFERENCES + "SELECT repo, symbol, count(*) AS n_lines, count(DISTINCT file_path) AS n_files FROM found GROUP BY ALL",
    "manifest_diff": f"SELECT guid, CASE WHEN a.guid IS NULL THEN 'new' WHEN b.guid IS NULL THEN 'removed' WHEN a.p IS NOT DISTINCT FROM b.p THEN 'unchanged' ELSE 'changed' END AS status FROM ({_AT.format(m=BEFORE)}) a FULL JOIN ({_AT.format(m=AFTER)}) b USING (guid)",
    "incremental_replace": f"WITH old AS ({_COUNT.format('false')}), new AS ({_COUNT.format('true')}) SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.repo = old.repo AND new.file_path = old.file_path) UNION ALL SELECT * FROM new",
    "md_sections": r"""WITH parts AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n(#{1,6} )', chr(1) || '\1', 'g'), chr(1)) AS p FROM documents WHERE text IS NOT NULL),
one AS (SELECT doc_id, i - 1 AS position, p[i] AS s FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM parts))
SELECT doc_id, position::INTEGER AS position, length(regexp_extract(s, '\A(#{1,6}) ', 1))::INTEGER AS level, regexp_extract(s, '\A#{1,6} +([^\n]*)', 1) AS title, length(s)::INTEGER AS n_chars FROM one""",
    "stream_window_counts": _DELIVERED + "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM marked WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark GROUP BY ALL",
    "stream_dedup": _DELIVERED + "SELECT DISTINCT event_id, user_id, event_type FROM marked WHERE mark IS NULL OR ts > mark",
}

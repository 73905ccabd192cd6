"""Searches: pages of ranked hits, filters before ranking, merging of collections, expansion along the graph, lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators.graph import spread_activation
from corvane.operators.nearest import nearest
from corvane.operators.retrieval import fuse_ranks


def numbered(rows: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """rows with position (from 1) and total within each group."""
    group = W.partitionBy(*groups)
    return rows.withColumns({"position": F.row_number().over(group.orderBy(*order)), "total": F.count(F.lit(1)).over(group)})


def page(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], offset: int = 0, limit: int = 20) -> DataFrame:
    """rows of one page of each group with position, total and next_offset (null on the last page)."""
    if offset < 0 or limit < 1:
        raise ValueError("a page begins at 0 or later and has one row at least")
    after = offset + limit
    found = numbered(rows, groups, order).where((F.col("position") > offset) & (F.col("position") <= after))
    return found.withColumn("next_offset", F.when(F.col("total") > after, F.lit(after)))


def filtered_page(vectors: DataFrame, queries: DataFrame, equal: dict[str, object], offset: int = 0, limit: int = 10, low: float | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, position, key, distance: a page of the nearest among the rows whose columns equal the given values.

    The filter is applied before ranking, so it reaches the scan and no page is short while there are hits; if low is
    given, hits at that distance or beyond are no matches and are dropped before paging, too.
    """
    kept = reduce(lambda rows, pair: rows.where(F.col(pair[0]) == F.lit(pair[1])), equal.items(), vectors)
    hits = nearest(kept, queries, k=offset + limit, key=key, vector=vector, distance="distance")
    if low is not None:
        hits = hits.where(F.col("distance") < low)
    return hits.where(F.col("rank") > offset).select("query_id", (F.col("rank") - offset).alias("position"), key, "distance")


def under_prefix(rows: DataFrame, path: str, prefix: str) -> DataFrame:
    """The rows whose path begins with prefix (with / for \\)."""
    return rows.where(F.replace(F.col(path), F.lit("\\"), F.lit("/")).startswith(prefix.replace("\\", "/")))


def merge_collections(hits: DataFrame, limit: int, key: str = "vec_id") -> DataFrame:
    """query_id, position, collection, key, score: the best of several collections by their scores; of a key that several
    collections give, the best counts. Ties fall to the collection, then to the key."""
    best = hits.groupBy("query_id", key).agg(F.max_by(F.struct("collection", "score"), F.struct("score", F.col("collection"))).alias("__best"))
    flat = best.select("query_id", "__best.collection", key, "__best.score")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "collection", key)
    return flat.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def first_per_group(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int = 3) -> DataFrame:
    """The k first rows of each group with their rank (a top-k report)."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= k)


def expand_hits(hits: DataFrame, edges: DataFrame, chunks: DataFrame, limit: int, classes: int = 8, per_class: int = 3) -> DataFrame:
    """repo, position, chunk_no, fused, found_by: hits (repo, chunk_no, rank) with chunks of the classes next to theirs.

    The classes of the hits are the seeds of an activation over edges (repo, class_name, used_class). The chunks of the
    classes with most energy that aren't hits already make a second list, and both are fused by their ranks; of equal
    sums the hit comes first. chunks has repo, chunk_no, class_name, type_rank and start_line.
    """
    own = chunks.where("class_name <> ''").join(hits.select("repo", "chunk_no"), ["repo", "chunk_no"], "left_semi")
    seeds = own.select("repo", "class_name").distinct()
    energy = spread_activation(edges, seeds).withColumn("energy", F.round("energy", 9))
    near = first_per_group(energy, ["repo"], [F.desc("energy"), F.col("class_name")], classes).drop("rank")
    found = chunks.join(near, ["repo", "class_name"]).join(hits.select("repo", "chunk_no"), ["repo", "chunk_no"], "left_anti")
    kept = first_per_group(found, ["repo", "class_name"], [F.col("type_rank"), F.col("start_line").asc_nulls_first(), F.col("chunk_no")], per_class).drop("rank")
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("energy"), "class_name", "type_rank", F.col("start_line").asc_nulls_first(), "chunk_no")))
    lists = [hits.select("repo", "chunk_no", "rank").withColumn("found_by", F.lit("hit")), ranked.select("repo", "chunk_no", "rank").withColumn("found_by", F.lit("graph"))]
    fused = fuse_ranks(lists, ["repo", "chunk_no", "found_by"])
    order = W.partitionBy("repo").orderBy(F.desc(F.round("fused", 12)), F.desc("found_by"), "chunk_no")
    return fused.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).select("repo", "position", "chunk_no", "fused", "found_by")


def lookup(asked: DataFrame, names: DataFrame) -> DataFrame:
    """asked, status, matches (sorted): what each asked name stands for among names (distinct, column name).

    An exact name is found at once. Else names that hold the asked one without regard to case are looked for: none is
    not_found, one is found, several are a disambiguation. The asked names are a stated set of queries; they meet the
    names in one pass, by a join on substrings, which Spark does with the asked side broadcast if it is small.
    """
    a, n = asked.select("asked").distinct(), names.where("name is not null").select("name").distinct()
    met = a.join(n, F.contains(F.lower("name"), F.lower("asked")), "left")
    exact = F.coalesce(F.max(F.col("name") == F.col("asked")), F.lit(False))
    made = met.groupBy("asked").agg(exact.alias("__exact"), F.sort_array(F.collect_set("name")).alias("__near"))
    status = F.when(F.col("__exact") | (F.size("__near") == 1), "found").when(F.size("__near") == 0, "not_found").otherwise("disambiguation")
    return made.select("asked", status.alias("status"), F.when(F.col("__exact"), F.array("asked")).otherwise(F.col("__near")).alias("matches"))


def thresholds_or_default(repos: DataFrame, calibration: DataFrame, high: float = 650.0, medium: float = 775.0, low: float = 875.0) -> DataFrame:
    """repo, high, medium, low: the calibrated thresholds of each repo, or the defaults."""
    default = {"high": high, "medium": medium, "low": low}
    return repos.select("repo").distinct().join(calibration, "repo", "left").select("repo", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in default.items()))

"""Nearest neighbours of a stated set of queries among all vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries are broadcast in blocks of about so many, however many there are; each block is one more pass over the vectors.
BLOCK = 4096


#: So many queries meet a batch of vectors at once, which bounds the matrix of distances.
TILE = 256


def _nearest_of(ids: np.ndarray, matrix: np.ndarray, keys: np.ndarray, rows: np.ndarray, k: int, key: str) -> pd.DataFrame:
    """The k rows nearest to each query by distances rounded as they are ranked, ties by key; all that tie are weighed."""
    distance = np.round((matrix**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2 * matrix @ rows.T, 9)
    distance[ids[:, None] == keys[None, :]] = np.inf
    bound = np.partition(distance, k - 1, axis=1)[:, k - 1] if len(keys) > k else np.full(len(ids), np.inf)
    query, row = np.nonzero((distance <= bound[:, None]) & np.isfinite(distance))
    order = np.lexsort((keys[row], distance[query, row], query))
    query, row = query[order], row[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    query, row = query[place < k], row[place < k]
    return pd.DataFrame({"query_id": ids[query], key: keys[row], "__d": distance[query, row]})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, distance: str | None = None) -> DataFrame:
    """query_id, rank, key: the k vectors of least squared distance to each query, itself left out; ties by key.

    If distance names a column, the squared distance comes out under that name. Distances are rounded to 9 decimals before
    they are compared.

    Each batch gives its own k best of each query, so only those are shuffled. Null vectors are left out.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("__q"), F.col(vector).alias("__v"))
    n_blocks = max(1, -(-asked.count() // block))
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("__key"), F.col(vector).alias("__v"))
    spark, found = vectors.sparkSession, []
    kind = vectors.schema[key].dataType.simpleString()
    for b in range(n_blocks):
        part = [(r["__q"], r["__v"]) for r in asked.where(F.pmod(F.xxhash64("__q"), F.lit(n_blocks)) == b).toLocalIterator()]
        if not part:
            continue
        shared = spark.sparkContext.broadcast((np.array([p[0] for p in part]), np.array([p[1] for p in part], dtype=np.float64)))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            for batch in batches:
                keys, rows = batch["__key"].to_numpy(), np.stack(batch["__v"].to_numpy()).astype(np.float64)
                for at in range(0, len(ids), TILE):
                    yield _nearest_of(ids[at : at + TILE], matrix[at : at + TILE], keys, rows, k, key)

        found.append(rows.mapInPandas(best, f"query_id {kind}, `{key}` {kind}, __d double"))
    if not found:
        return spark.createDataFrame([], f"query_id {kind}, rank int, `{key}` {kind}" + (f", `{distance}` double" if distance else ""))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("__d", key))
    return reduce(DataFrame.unionByName, found).select("query_id", rank.alias("rank"), key, *([F.col("__d").alias(distance)] if distance else [])).where(F.col("rank") <= k)

"""Similar names for names that aren't found: by shared words, by substrings, by edits."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words of a name: from a capital to the next, or all capitals.
NAME_WORDS = r"([A-Z]?[a-z]+|[A-Z]{2,})"


def name_words(name: Column) -> Column:
    """The distinct words of a name in lower case, of two letters at least."""
    words = F.transform(F.regexp_extract_all(name, F.lit(NAME_WORDS)), lambda w: F.lower(w))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 1))


def by_shared_words(asked: DataFrame, names: DataFrame, k: int = 5) -> DataFrame:
    """asked, rank, name, n_shared: the names with most words in common with each asked name, itself left out.

    Names meet by their words, each pair once for each word in common, so names without a common word never meet. A word
    that a large share of the names has is one key of the join: asked is a stated set of queries, whose size bounds it.
    """
    a = asked.select("asked").distinct().select("asked", F.explode(name_words(F.col("asked"))).alias("__word"))
    n = names.where("name is not null").select("name").distinct().select("name", F.explode(name_words(F.col("name"))).alias("__word"))
    shared = a.join(n, "__word").where("name <> asked").groupBy("asked", "name").agg(F.count(F.lit(1)).alias("n_shared"))
    order = W.partitionBy("asked").orderBy(F.desc("n_shared"), "name")
    return shared.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("asked", "rank", "name", "n_shared")


def by_edits(asked: DataFrame, names: DataFrame, k: int = 5, least: float = 0.5, block: int = 256) -> DataFrame:
    """asked, rank, name, ratio: the names most like each asked name by the share of characters in common runs.

    The asked names are a stated set of queries: they are broadcast in blocks, and each batch of names gives its own k
    best of each, so only those are shuffled. Ties fall to the name; the asked name itself is left out.
    """
    names = names.where("name is not null").select("name").distinct()
    queries = asked.where("asked is not null").select("asked").distinct()
    n_blocks = max(1, -(-queries.count() // block))
    found = None
    for b in range(n_blocks):
        part = [r["asked"] for r in queries.where(F.pmod(F.xxhash64("asked"), F.lit(n_blocks)) == b).toLocalIterator()]

        def alike(batches: Iterator[pd.DataFrame], part: list[str] = part) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for query in part:
                    matcher = SequenceMatcher(autojunk=False)
                    matcher.set_seq2(query)
                    near = []
                    for name in batch["name"]:
                        matcher.set_seq1(name)
                        if name != query and matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least and (ratio := matcher.ratio()) >= least:
                            near.append((query, name, ratio))
                    out += sorted(near, key=lambda x: (-x[2], x[1]))[:k]
                yield pd.DataFrame(out, columns=["asked", "name", "ratio"])

        one = names.mapInPandas(alike, "asked string, name string, ratio double")
        found = one if found is None else found.unionByName(one)
    order = W.partitionBy("asked").orderBy(F.desc("ratio"), "name")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("asked", "rank", "name", "ratio")


def suggestions(asked: DataFrame, names: DataFrame, k: int = 5, least: float = 0.4) -> DataFrame:
    """asked, rank, name: names that share words first, then those that hold the asked one, then those alike by edits."""
    words = by_shared_words(asked, names, k).select("asked", F.lit(0).alias("__kind"), "rank", "name")
    plain = names.where("name is not null").select("name").distinct()
    holds = asked.select("asked").distinct().join(plain, F.contains(F.lower("name"), F.lower("asked"))).where("name <> asked")
    held = holds.withColumn("rank", F.row_number().over(W.partitionBy("asked").orderBy("name"))).where(F.col("rank") <= k).select("asked", F.lit(1).alias("__kind"), "rank", "name")
    edits = by_edits(asked, names, k, least).select("asked", F.lit(2).alias("__kind"), "rank", "name")
    best = words.unionByName(held).unionByName(edits).groupBy("asked", "name").agg(F.min(F.struct("__kind", "rank")).alias("__at"))
    order = W.partitionBy("asked").orderBy("__at", "name")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("asked", "rank", "name")

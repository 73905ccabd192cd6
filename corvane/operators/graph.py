"""Graph operators over edges (repo, class_name, used_class): spreading activation, PageRank, communities.

Every repository is a graph of its own and all of them are worked on at once. Each round is a join and a sum; the state
has one row for each node and is written to the checkpoint folder, so plans don't grow with the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators.skew import hot_keys, replicate_rows, salt_rows, salted_join
from corvane.session import cut_lineage


def both_ways(edges: DataFrame) -> DataFrame:
    """repo, node, other: each edge from either end; a pair of classes that use each other comes out twice."""
    once = edges.where("class_name <> used_class").select("repo", "class_name", "used_class").distinct()
    ends = F.array(F.struct(F.col("class_name").alias("a"), F.col("used_class").alias("b")), F.struct(F.col("used_class").alias("a"), F.col("class_name").alias("b")))
    return once.select("repo", F.explode(ends).alias("e")).select("repo", F.col("e.a").alias("node"), F.col("e.b").alias("other"))


def spread_activation(edges: DataFrame, seeds: DataFrame, decay: float = 0.7, hops: int = 2, k: int = 10) -> DataFrame:
    """repo, class_name, energy of the classes that energy from the seeds (repo, class_name) reaches, seeds left out.

    A seed starts with 1. In each hop every class of the front sends decay times its energy along each edge, either
    way; the k classes of each repository that got most (ties by name) are the next front and keep what they got.
    """
    links = both_ways(edges)
    front = seeds.select("repo", F.col("class_name").alias("node")).distinct().withColumn("energy", F.lit(1.0))
    most = W.partitionBy("repo").orderBy(F.desc(F.round("energy", 9)), "node")
    gained = None
    for _ in range(hops):
        sent = salted_join(links, front, ["repo", "node"], F.col("other")).groupBy("repo", F.col("other").alias("node")).agg(F.sum(F.col("energy") * decay).alias("energy"))
        front = cut_lineage(sent.withColumn("__rank", F.row_number().over(most)).where(F.col("__rank") <= k).drop("__rank"))
        gained = front if gained is None else gained.unionByName(front)
    total = gained.groupBy("repo", F.col("node").alias("class_name")).agg(F.sum("energy").alias("energy"))
    return total.join(seeds.select("repo", "class_name"), ["repo", "class_name"], "left_anti")


def page_rank(edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, most_rounds: int = 200, rounds_per_cut: int = 4) -> DataFrame:
    """repo, class_name, page_rank once the ranks of every repository change by less than tolerance times its classes in a round.

    The ranks of a repository sum to 1. What classes without outgoing edges hold is shared evenly. Edges of hot sources are
    salted once, before the rounds. Convergence is asked, and lineage cut, every few rounds; ranks that haven't settled
    after most_rounds are an error.
    """
    once = edges.where("class_name <> used_class").select("repo", F.col("class_name").alias("node"), F.col("used_class").alias("to")).distinct()
    hot = cut_lineage(hot_keys(once, ["repo", "node"]))
    salted = cut_lineage(salt_rows(once, hot, ["repo", "node"], F.col("to")))
    ends = salted.select("repo", F.explode(F.array(F.struct(F.col("node").alias("v"), F.lit(1).alias("o")), F.struct(F.col("to").alias("v"), F.lit(0).alias("o")))).alias("e"))
    nodes = ends.groupBy("repo", F.col("e.v").alias("node")).agg(F.sum("e.o").alias("n_out"))
    sizes = cut_lineage(nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("n")))
    state = cut_lineage(nodes.join(sizes, "repo").select("repo", "node", "n_out", "n", (1 / F.col("n")).alias("held")))
    for _ in range(0, most_rounds, rounds_per_cut):
        for _ in range(rounds_per_cut):
            giving = replicate_rows(state.where("n_out > 0").select("repo", "node", (F.col("held") / F.col("n_out")).alias("gift")), hot, ["repo", "node"])
            given = salted.join(giving, ["repo", "node", "__salt"]).groupBy("repo", F.col("to").alias("node")).agg(F.sum("gift").alias("got"))
            idle = state.where("n_out = 0").groupBy("repo").agg(F.sum("held").alias("idle"))
            held = (1 - alpha) / F.col("n") + alpha * (F.coalesce("got", F.lit(0.0)) + F.coalesce("idle", F.lit(0.0)) / F.col("n"))
            state = state.withColumnRenamed("held", "was").join(given, ["repo", "node"], "left").join(idle, "repo", "left").select("repo", "node", "n_out", "n", "was", held.alias("held"))
            last, state = state, state.drop("was")
        last = cut_lineage(last)
        state = last.drop("was")
        moved = last.groupBy("repo").agg((F.sum(F.abs(F.col("held") - F.col("was"))) / F.max("n")).alias("__m")).agg(F.coalesce(F.max("__m"), F.lit(0.0))).first()[0]
        if moved < tolerance:
            return state.select("repo", F.col("node").alias("class_name"), F.col("held").alias("page_rank"))
    raise ValueError(f"the ranks still move by {moved} after {most_rounds} rounds")


def communities(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """repo, class_name, community by label propagation: a class takes the label most of its neighbours hold, its own first.

    Labels start as names. In each round half of the classes may change, chosen by a hash of name and round, so neighbours
    don't swap labels for ever; a class keeps its label if no other is held by more neighbours, ties else fall to the
    least. The rounds end when no class would change any more, in either half; labels that haven't settled after
    most_rounds are an error. Classes without edges aren't in it.
    """
    links = cut_lineage(both_ways(edges))
    state = cut_lineage(links.select("repo", "node").distinct().withColumn("label", F.col("node")))
    for number in range(most_rounds):
        heard = salted_join(links, state.withColumnRenamed("node", "other"), ["repo", "other"], F.col("node")).groupBy("repo", "node", "label").agg(F.count(F.lit(1)).alias("n"))
        own = state.withColumnRenamed("label", "own")
        voted = heard.join(own, ["repo", "node"])
        top = F.max(F.struct("n", (F.col("label") == F.col("own")).alias("mine")))
        most = voted.groupBy("repo", "node", "own").agg(top.alias("__top"))
        least = voted.join(most.select("repo", "node", F.col("__top.n").alias("n")), ["repo", "node", "n"]).groupBy("repo", "node").agg(F.min("label").alias("__least"))
        chosen = F.when(F.col("__top.mine"), F.col("own")).otherwise(F.col("__least"))
        turn = F.substring(F.md5(F.concat("node", F.lit(f"/{number}"))), 1, 1) < "8"
        wanted = cut_lineage(most.join(least, ["repo", "node"]).select("repo", "node", "own", chosen.alias("want"), turn.alias("turn")))
        if wanted.where("own <> want").isEmpty():
            return state.select("repo", F.col("node").alias("class_name"), F.col("label").alias("community"))
        state = wanted.select("repo", "node", F.when(F.col("turn"), F.col("want")).otherwise(F.col("own")).alias("label"))
    raise ValueError(f"labels still change after {most_rounds} rounds")

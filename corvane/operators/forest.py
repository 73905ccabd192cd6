"""Parent-child links to full hierarchies by pointer doubling.

Only nodes that are somebody's parent take part in the doubling; all others wait for their parent and are joined with
it once, at the end. Each of those starts with a pointer to its parent. Each round joins the pointers with themselves,
which doubles the length of the jump, so a tree of depth d is done after log2(d) + 1 rounds. Depths have no gaps: a
round that finishes no node proves that those left lie on a cycle or below one. Each round is written to the checkpoint
folder, so that a lost executor costs at most one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.keys import strip_blanks
from corvane.operators.skew import HOT_SHARE, join_around, salts_of
from corvane.session import cut_lineage


def latest_nodes(rows: DataFrame, tree: str, node: str, parent: str, children: str, version: str) -> DataFrame:
    """One row for each (tree, node): the one of latest version; equal versions fall to the largest parent, then children."""
    pick = F.struct(F.col(version), F.col(parent), F.col(children))
    return (
        rows.where(F.col(node).isNotNull())
        .groupBy(F.col(tree).alias("__tree"), F.col(node).alias("__node"))
        .agg(F.max(pick).alias("__row"))
        .select("__tree", "__node", F.col("__row").getField(parent).alias("__parent"), F.col("__row").getField(children).alias("__children"))
    )


def parent_links(
    rows: DataFrame,
    tree: str = "asset_path",
    node: str = "file_id",
    parent: str = "parent_id",
    children: str = "children_ids",
    version: str = "seen_at",
) -> DataFrame:
    """__tree, __node, __parent of each node of latest version; __parent is null where none is named.

    The parent is the stated one without surrounding blanks; where that is null or empty, the node of the same tree
    that lists it among its children (of several, the least). "0" names none. Whether the tree holds the parent isn't
    asked here. Nodes and listings meet in one aggregation, so nothing is joined.
    """
    nodes = latest_nodes(rows, tree, node, parent, children, version)
    nothing = F.lit(None).cast("string")
    stated = nodes.select("__tree", "__node", F.nullif(strip_blanks(F.col("__parent")), F.lit("")).alias("__stated"), nothing.alias("__lister"), F.lit(True).alias("__is"))
    listed = nodes.select("__tree", F.explode("__children").alias("__node"), F.col("__node").alias("__lister")).select(
        "__tree", strip_blanks(F.col("__node")).alias("__node"), nothing.alias("__stated"), "__lister", F.lit(False).alias("__is")
    )
    both = stated.unionByName(listed).groupBy("__tree", "__node").agg(F.max("__is").alias("__is"), F.max("__stated").alias("__stated"), F.min("__lister").alias("__lister"))
    return both.where("__is").select("__tree", "__node", F.nullif(F.coalesce("__stated", "__lister"), F.lit("0")).alias("__parent"))


def _double(core: DataFrame, paths: bool) -> tuple[list[DataFrame], DataFrame]:
    """The finished parts of the pointers after all rounds, and what never finishes.

    A node that no pointer aims at is never aimed at again, for its pointer's new aim is an aim of this round. So the
    core, which holds the aims of each round, shrinks with the height of the nodes, and only the core is joined with.
    The count of pointers for each aim also tells how many are left and which aims are so hot that their rows are to be
    cut into parts.
    """
    keys, done, rest, before = ["__tree", "__up"], [], core.where("false"), None
    while True:
        left = core.where("not __done").unionByName(rest)
        aimed = cut_lineage(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))
        n_left, most = aimed.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(0))).first()
        if n_left in (0, before):
            return [*done, core.where("__done")], left
        hot = salts_of(aimed, keys, n_left) if most > max(n_left // HOT_SHARE, 1) else None
        flags = aimed.select("__tree", F.col("__up").alias("__node"), F.lit(True).alias("__aimed"))
        split = cut_lineage(core.join(flags, ["__tree", "__node"], "left").withColumn("__aimed", F.coalesce("__aimed", F.lit(False))))
        targets = split.where("__aimed")
        done.append(split.where("__done and not __aimed").drop("__aimed"))
        ahead = targets.select(
            "__tree",
            F.col("__node").alias("__up"),
            F.col("__up").alias("__far"),
            F.col("__steps").alias("__more"),
            F.col("__done").alias("__ended"),
            *([F.col("__path").alias("__above")] if paths else []),
        )
        going = split.where("not __done").unionByName(rest.withColumn("__aimed", F.lit(False)))
        joined = cut_lineage(
            join_around(hot, going, ahead, keys, F.col("__node")).select(
                "__tree",
                "__node",
                F.col("__far").alias("__up"),
                (F.col("__steps") + F.col("__more")).alias("__steps"),
                F.col("__ended").alias("__done"),
                *([F.concat("__above", "__path").alias("__path")] if paths else []),
                "__aimed",
            )
        )
        core = targets.where("__done").unionByName(joined.where("__aimed")).drop("__aimed")
        done.append(joined.where("__done and not __aimed").drop("__aimed"))
        rest, before = joined.where("not __done and not __aimed").drop("__aimed"), n_left


def resolve_forest(links: DataFrame, paths: bool = True) -> DataFrame:
    """__tree, __node, root_id, depth and, if paths, path (array of ids from the root to the node).

    A node whose parent is null or not in its tree is a root. A node on a cycle or below one has root_id '', depth -1
    and an empty path. Without paths that column isn't made, as column pruning would do: a path is as long as the node
    is deep. links must have one row for each (tree, node), as parent_links gives them; no rows give no rows.
    """
    links = cut_lineage(links)
    named = links.where("__parent is not null").groupBy("__tree", F.col("__parent").alias("__node")).agg(F.count(F.lit(1)).alias("__n"))
    sized = links.alias("l").join(named.alias("n"), [F.col("l.__tree").eqNullSafe(F.col("n.__tree")), F.col("l.__node") == F.col("n.__node")], "left")
    nodes = cut_lineage(sized.select("l.__tree", "l.__node", "l.__parent", F.coalesce("n.__n", F.lit(0)).alias("__n")))
    inner = nodes.where("__n > 0")
    keys = ["__tree", "__parent"]
    hot = cut_lineage(salts_of(inner.select("__tree", F.col("__node").alias("__parent"), "__n"), keys, links.count()))
    held = inner.select("__tree", F.col("__node").alias("__parent"), F.lit(True).alias("__held"))
    pointed = join_around(hot, inner.where("__parent is not null"), held, keys, F.col("__node"), "left")
    pointers = pointed.select("__tree", "__node", F.when(F.col("__held"), F.col("__parent")).alias("__parent")).unionByName(
        inner.where("__parent is null").select("__tree", "__node", "__parent")
    )
    root = F.col("__parent").isNull()
    columns = [F.coalesce("__parent", "__node").alias("__up"), F.when(root, 0).otherwise(1).alias("__steps"), root.alias("__done")]
    if paths:
        columns.append(F.array("__node").alias("__path"))  # the nodes below __up, or the root itself
    done, stuck = _double(cut_lineage(pointers.select("__tree", "__node", *columns)), paths)
    good = reduce(DataFrame.unionByName, done).select(
        "__tree", "__node", F.col("__up").alias("root_id"), F.col("__steps").alias("depth"), *([F.col("__path").alias("path")] if paths else [])
    )
    bad = stuck.select(
        "__tree", "__node", F.lit("").alias("root_id"), F.lit(-1).alias("depth"), *([F.array().cast("array<string>").alias("path")] if paths else [])
    )
    known = good.unionByName(bad)
    above = known.select("__tree", F.col("__node").alias("__parent"), F.col("root_id").alias("__root"), F.col("depth").alias("__depth"), *([F.col("path").alias("__above")] if paths else []))
    outer = nodes.where("__n = 0").select("__tree", "__node", "__parent")
    below = join_around(hot, outer.where("__parent is not null"), above, keys, F.col("__node"), "left")
    lone = F.col("__depth").isNull()
    path = F.when(lone, F.array("__node")).when(F.col("__depth") < 0, F.col("__above")).otherwise(F.concat("__above", F.array("__node")))
    outside = below.select(
        "__tree",
        "__node",
        F.when(lone, F.col("__node")).otherwise(F.col("__root")).alias("root_id"),
        F.when(lone, 0).when(F.col("__depth") < 0, -1).otherwise(F.col("__depth") + 1).alias("depth"),
        *([path.alias("path")] if paths else []),
    )
    roots = outer.where("__parent is null").select("__tree", "__node", F.col("__node").alias("root_id"), F.lit(0).alias("depth"), *([F.array("__node").alias("path")] if paths else []))
    return known.unionByName(outside).unionByName(roots)


def hierarchy(rows: DataFrame, tree: str = "asset_path", node: str = "file_id", paths: bool = True, **names: str) -> DataFrame:
    """tree, node, root_id, depth and path of each node; rows without a node id are left out. See resolve_forest."""
    made = resolve_forest(parent_links(rows, tree=tree, node=node, **names), paths)
    return made.withColumnsRenamed({"__tree": tree, "__node": node})


def descendants(tree_rows: DataFrame, tree: str = "asset_path", node: str = "file_id") -> DataFrame:
    """tree, node, descendant_id, distance: one row for each node and node below it, from the paths of hierarchy().

    Rows, not lists: no node's descendants are ever gathered in one place.
    """
    size = F.size("path")
    return (
        tree_rows.where("depth > 0")
        .select(F.col(tree), F.col(node).alias("descendant_id"), size.alias("__size"), F.posexplode("path").alias("__at", node))
        .where("__at < __size - 1")
        .select(tree, node, "descendant_id", (F.col("__size") - 1 - F.col("__at")).alias("distance"))
    )

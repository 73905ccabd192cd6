"""The dependency graph of classes: nodes by key, edges between keys, and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators.corpus import code_of_classes, type_names
from corvane.operators.skew import salted_join

# Statements that import names (RE2 and Java alike); group 1 holds the names or the path.
PYTHON_FROM = r"(?m)^[ \t]*from[ \t]+[\w.]+[ \t]+import[ \t]+\(?([\w, \t]+)"
SCRIPT_DEFAULT = r"(?m)^[ \t]*import[ \t]+(?:type[ \t]+)?(\w+)[ \t]*(?:,|[ \t]from\b)"
SCRIPT_NAMED = r"\b(?:import|export)[ \t]+(?:type[ \t]+)?(?:\w+[ \t]*,[ \t]*)?\{([^{}]*)\}[ \t]*from\b"
REQUIRED = r"\brequire[ \t]*\(?[ \t]*['\"]([\w./-]+)['\"]"
INTEROP = r"\bCS((?:\.\w+)+)"


def node_key(class_name: Column, namespace: Column, module: Column, file_path: Column) -> Column:
    """namespace.class, or class@@module@@file for a class without a namespace."""
    return F.when(namespace != "", F.concat(namespace, F.lit("."), class_name)).otherwise(F.concat_ws("@@", class_name, F.coalesce(module, F.lit("")), F.coalesce(file_path, F.lit(""))))


def class_of_key(key: Column) -> Column:
    """The class of a node key."""
    return F.when(key.contains("@@"), F.substring_index(key, "@@", 1)).otherwise(F.substring_index(key, ".", -1))


def import_names(source: Column) -> Column:
    """The distinct names that imports of Python, JavaScript, TypeScript and Lua bring in, sorted.

    An alias counts by its original name; of a required path each part counts that is a word.
    """
    every = lambda pattern: F.regexp_extract_all(source, F.lit(pattern), 1)
    listed = F.flatten(F.transform(F.concat(every(PYTHON_FROM), every(SCRIPT_NAMED)), lambda x: F.split(x, ",")))
    plain = F.transform(listed, lambda x: F.regexp_extract(x, r"(\w+)", 1))
    parts = F.flatten(F.transform(F.concat(every(REQUIRED), every(INTEROP)), lambda x: F.split(x, "[./]")))
    names = F.array_distinct(F.concat(plain, every(SCRIPT_DEFAULT), F.transform(parts, lambda x: F.regexp_extract(x, r"(\w*)", 1))))
    return F.sort_array(F.filter(names, lambda x: (x != "") & (x != "type")))


def references_of_files(chunks: DataFrame) -> DataFrame:
    """repo, class_name, file_path, namespace, module, refs: what the code of each class names in each file.

    One row for each class and file; namespace and module are those of the chunk of least number. refs are names of types
    and of imports, sorted, without the class itself.
    """
    lined = F.regexp_replace("source", r"\r\n?", "\n")
    code = code_of_classes(chunks).withColumn("__refs", F.array_union(type_names(F.col("source")), import_names(lined)))
    first = F.min(F.struct("chunk_no", F.coalesce("namespace", F.lit("")).alias("namespace"), F.coalesce("module", F.lit("")).alias("module")))
    made = code.groupBy("repo", "class_name", "file_path").agg(first.alias("__first"), F.array_distinct(F.flatten(F.collect_set("__refs"))).alias("__refs"))
    return made.select("repo", "class_name", "file_path", "__first.namespace", "__first.module", F.sort_array(F.array_remove("__refs", F.col("class_name"))).alias("refs"))


def nodes(contributions: DataFrame) -> DataFrame:
    """repo, node_key, class_name, namespace, module, files, refs: files and refs of partial classes are merged.

    contributions are those of references_of_files; of several modules the one of the least file that has one counts.
    """
    keyed = contributions.withColumn("node_key", node_key(F.col("class_name"), F.col("namespace"), F.col("module"), F.col("file_path")))
    module = F.min(F.when(F.col("module") != "", F.struct("file_path", "module")))
    return keyed.groupBy("repo", "node_key").agg(
        F.min("class_name").alias("class_name"),
        F.min("namespace").alias("namespace"),
        F.coalesce(module.getField("module"), F.lit("")).alias("module"),
        F.sort_array(F.collect_set("file_path")).alias("files"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"),
    )


def name_index(node_rows: DataFrame) -> DataFrame:
    """repo, class_name, node_keys (sorted): the nodes that a name may mean."""
    return node_rows.groupBy("repo", "class_name").agg(F.sort_array(F.collect_set("node_key")).alias("node_keys"))


def edges(node_rows: DataFrame) -> DataFrame:
    """repo, src, dst: a name links to every node that it may mean, but never to its own."""
    named = node_rows.select("repo", F.col("node_key").alias("src"), F.explode("refs").alias("class_name"))
    meant = node_rows.select("repo", "class_name", F.col("node_key").alias("dst"))
    return salted_join(named, meant, ["repo", "class_name"], F.col("src")).where("src <> dst").select("repo", "src", "dst").distinct()


def graph_totals(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """repo, n_nodes, n_edges; repositories without edges have 0."""
    both = node_rows.select("repo", F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(edge_rows.select("repo", F.lit(0).alias("n"), F.lit(1).alias("e")))
    return both.groupBy("repo").agg(F.sum("n").cast("bigint").alias("n_nodes"), F.sum("e").cast("bigint").alias("n_edges"))


def class_dependencies(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """repo, node_key, dependencies, dependents: the sorted keys next to each node; both may be empty."""
    ends = edge_rows.select("repo", F.explode(F.array(F.struct(F.col("src").alias("k"), F.col("dst").alias("d"), F.lit(None).cast("string").alias("r")), F.struct(F.col("dst").alias("k"), F.lit(None).cast("string").alias("d"), F.col("src").alias("r")))).alias("e"))
    none = node_rows.select("repo", F.col("node_key").alias("k"), F.lit(None).cast("string").alias("d"), F.lit(None).cast("string").alias("r"))
    return (
        ends.select("repo", "e.k", "e.d", "e.r")
        .unionByName(none)
        .groupBy("repo", F.col("k").alias("node_key"))
        .agg(F.sort_array(F.collect_set("d")).alias("dependencies"), F.sort_array(F.collect_set("r")).alias("dependents"))
    )


def aggregate_view(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """repo, class_name, n_nodes, files, dependencies, dependents of the names that stand for several nodes.

    Files and neighbours of all its nodes are merged; the nodes themselves aren't their own neighbours.
    """
    near = node_rows.join(class_dependencies(node_rows, edge_rows), ["repo", "node_key"])
    merged = near.groupBy("repo", "class_name").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.collect_set("node_key").alias("__own"),
        *(F.array_distinct(F.flatten(F.collect_list(c))).alias(f"__{c}") for c in ("files", "dependencies", "dependents")),
    )
    other = lambda c: F.sort_array(F.array_except(c, "__own")).alias(c[2:])
    return merged.where("n_nodes > 1").select("repo", "class_name", "n_nodes", F.sort_array("__files").alias("files"), other("__dependencies"), other("__dependents"))


def module_distribution(labels: DataFrame, node_rows: DataFrame, k: int = 6) -> DataFrame:
    """community, module, n_classes, first_classes (the k least names, a report) of labelled classes (repo, class_name, community)."""
    placed = labels.join(node_rows.groupBy("repo", "class_name").agg(F.min("module").alias("module")), ["repo", "class_name"])
    order = W.partitionBy("repo", "community", "module").orderBy("class_name")
    ranked = placed.withColumn("__at", F.row_number().over(order))
    return ranked.groupBy("repo", "community", "module").agg(F.count(F.lit(1)).alias("n_classes"), F.sort_array(F.collect_list(F.when(F.col("__at") <= k, F.col("class_name")))).alias("first_classes"))

"""Analytics over parsed chunks: listings, type hierarchies, dependency graphs, references and asset links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.keys import normal_guid, normal_label, normal_path, strip_blanks

#: What can be the name of a type in source text, if it has a small letter (MAX_SIZE has none).
TYPE_NAME = r"\b[A-Z]\w{2,}\b"

# The types of chunks that hold code of a class, and the order in which a file's chunks are listed.
CODE_TYPES = ("whole_class", "class_summary", "method", "constructor", "property", "function")
TYPE_ORDER = ("class_summary", "whole_class", "prefab_summary", "constructor", "property", "method", "function", "gameobject", "component", "template")

#: What is taken out of source before names are read, in this order: strings of a line, block comments, line comments,
#: lines of attributes and lines that are comments or directives. Pairs of a pattern (RE2 and Java alike) and what stays.
NOISE = (
    (r'"[^"\n]*"', '""'),
    (r"(?s)/\*.*?\*/", " "),
    (r"//[^\n]*", ""),
    (r"(?s)--\[\[.*?\]\]", " "),
    (r"(?m)(^|[ \t])--[^\n]*", " "),
    (r"(?m)^[ \t]*\[[^\]\n]*\]", ""),
    (r"(?m)^[ \t]*#[^\n]*", ""),
)


def without_noise(source: Column) -> Column:
    """Source without comments, strings and attributes, by NOISE; line ends are \\n after it."""
    clean = F.regexp_replace(source, r"\r\n?", "\n")
    for pattern, kept in NOISE:
        clean = F.regexp_replace(clean, pattern, kept)
    return clean


def type_names(source: Column) -> Column:
    """The distinct names of types in source that is no comment, string or attribute, as an array."""
    found = F.array_distinct(F.regexp_extract_all(without_noise(source), F.lit(f"({TYPE_NAME})")))
    return F.filter(found, lambda name: name.rlike("[a-z]"))


def type_rank(chunk_type: Column) -> Column:
    """The place of a chunk type in listings; others come last."""
    rank = F.lit(99)
    for number, name in reversed(list(enumerate(TYPE_ORDER))):
        rank = F.when(chunk_type == name, number).otherwise(rank)
    return rank


def latest_chunks(chunks: DataFrame, key: str = "chunk_no", version: str = "indexed_at") -> DataFrame:
    """One row for each key, of latest version (null is oldest), with normal paths and labels; null keys are left out."""
    columns = [c for c in chunks.columns if c != key]
    row = F.struct(F.col(version).alias("__version"), F.struct(*columns).alias("__row"))
    latest = chunks.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("__latest"))
    flat = latest.select(key, *(F.col(f"__latest.__row.{c}").alias(c) for c in columns))
    return flat.withColumns({"file_path": normal_path(F.col("file_path")), "chunk_type": normal_label(F.col("chunk_type"))})


def file_listing(chunks: DataFrame) -> DataFrame:
    """repo, file_path, position, chunk_no, chunk_type, start_line, end_line: each file's chunks in their order.

    By the rank of their type, then by line, null lines first; ties fall to the smaller chunk_no.
    """
    order = W.partitionBy("repo", "file_path").orderBy(type_rank(F.col("chunk_type")), F.col("start_line").asc_nulls_first(), "chunk_no")
    return latest_chunks(chunks).select("repo", "file_path", F.row_number().over(order).alias("position"), "chunk_no", "chunk_type", "start_line", "end_line")


def index_status(chunks: DataFrame) -> DataFrame:
    """repo, n_files, n_chunks, n_modules, last_indexed over latest rows; null modules don't count."""
    return latest_chunks(chunks).groupBy("repo").agg(
        F.count_distinct("file_path").alias("n_files"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_distinct("module").alias("n_modules"),
        F.max("indexed_at").alias("last_indexed"),
    )


def implementations(chunks: DataFrame) -> DataFrame:
    """base_type, class_name, repo, module: which classes name a type as their base; empty names are left out."""
    return (
        latest_chunks(chunks)
        .where("class_name <> ''")
        .select(F.explode("base_types").alias("base_type"), "class_name", "repo", "module")
        .withColumn("base_type", F.regexp_replace(strip_blanks(F.col("base_type")), r"<.*$", ""))
        .where("base_type <> ''")
        .distinct()
    )


def code_of_classes(chunks: DataFrame) -> DataFrame:
    """The latest chunks that hold code of a class with a name."""
    return latest_chunks(chunks).where(F.col("chunk_type").isin(*CODE_TYPES) & (F.col("class_name") != ""))


def dependencies(chunks: DataFrame) -> DataFrame:
    """repo, class_name, used_class, n_chunks: classes whose code names another known class of the same repo.

    Names in comments, strings and attributes don't count. They are taken apart inside the JVM and made distinct within a
    chunk before they meet the known classes.
    """
    code = code_of_classes(chunks)
    known = code.select("repo", F.col("class_name").alias("used_class")).distinct()
    named = code.select("repo", "class_name", F.explode(type_names(F.col("source"))).alias("used_class"))
    counted = named.where("used_class <> class_name").groupBy("repo", "class_name", "used_class").agg(F.count(F.lit(1)).alias("n_chunks"))
    return counted.join(known, ["repo", "used_class"], "left_semi").select("repo", "class_name", "used_class", "n_chunks")


def degrees(edges: DataFrame) -> DataFrame:
    """repo, class_name, n_out, n_in of every class with an edge, from one pass over the edges."""
    ends = edges.select("repo", F.explode(F.array(F.struct(F.col("class_name").alias("c"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("used_class").alias("c"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("repo", F.col("e.c").alias("class_name")).agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))


def top_degrees(edges: DataFrame, k: int = 10) -> DataFrame:
    """The k classes of each repo with most users, then most uses, then by name (a top-k report)."""
    order = W.partitionBy("repo").orderBy(F.desc("n_in"), F.desc("n_out"), "class_name")
    return degrees(edges).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def script_usage(components: DataFrame, scripts: list[DataFrame]) -> DataFrame:
    """script_guid, class_name, n_assets, n_components: where each script is used; unknown guids have a null class_name.

    Components are summed before the join, so a guid that holds a large share of them is one row there. Of several
    scripts for a guid the one of least path counts; empty guids are left out; repeated components count once.
    """
    guid = normal_guid(F.col("script_guid"))
    used = (
        components.select(guid.alias("script_guid"), "mb_no", "asset_path")
        .where("script_guid <> ''")
        .groupBy("script_guid")
        .agg(F.count_distinct("asset_path").alias("n_assets"), F.count_distinct("mb_no").alias("n_components"))
    )
    known = scripts[0]
    for more in scripts[1:]:
        known = known.unionByName(more)
    one = known.select(normal_guid(F.col("guid")).alias("script_guid"), "script_path", "class_name").groupBy("script_guid").agg(F.min(F.struct("script_path", "class_name")).getField("class_name").alias("class_name"))
    return used.join(one, "script_guid", "left").select("script_guid", "class_name", "n_assets", "n_components")


def ambiguous_classes(scripts: DataFrame) -> DataFrame:
    """class_name, n_guids, guids (sorted) of classes that stand for several guids, each of which is another script."""
    made = scripts.select("class_name", normal_guid(F.col("guid")).alias("guid")).where("class_name <> '' and guid <> ''").groupBy("class_name").agg(F.sort_array(F.collect_set("guid")).alias("guids"))
    return made.where(F.size("guids") > 1).select("class_name", F.size("guids").alias("n_guids"), "guids")


def enclosing_types(chunks: DataFrame) -> DataFrame:
    """chunk_no, outer_no, outer_class: the innermost chunk of a type whose lines hold those of another chunk of its file.

    Of types with the same lines the one of least number counts; a chunk doesn't hold itself. Types and members meet within
    their file, of which a file has few.
    """
    latest = latest_chunks(chunks).where("start_line is not null and end_line is not null")
    types = latest.where("chunk_type in ('whole_class', 'class_summary')").select("repo", "file_path", F.col("chunk_no").alias("outer_no"), F.col("class_name").alias("outer_class"), F.col("start_line").alias("__from"), F.col("end_line").alias("__to"))
    held = latest.select("repo", "file_path", "chunk_no", "start_line", "end_line").join(types, ["repo", "file_path"]).where("__from <= start_line and __to >= end_line and outer_no <> chunk_no")
    inner = F.min(F.struct(F.col("__to") - F.col("__from"), "outer_no", "outer_class"))
    return held.groupBy("chunk_no").agg(inner.alias("__in")).select("chunk_no", "__in.outer_no", "__in.outer_class")


def richest_types(chunks: DataFrame) -> DataFrame:
    """repo, class_name, n_bases, base_types: of the chunks of each class the base types of the one that names most.

    Of as many the chunk of least number counts; classes without bases have none.
    """
    code = code_of_classes(chunks).withColumn("__n", F.coalesce(F.size("base_types"), F.lit(0)))
    best = code.groupBy("repo", "class_name").agg(F.max(F.struct(F.greatest("__n", F.lit(0)).alias("n"), (-F.col("chunk_no")).alias("o"), "base_types")).alias("__b"))
    return best.select("repo", "class_name", F.col("__b.n").alias("n_bases"), F.coalesce("__b.base_types", F.array().cast("array<string>")).alias("base_types"))


def entity_chunks(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """name, chunk_no, matched (class, method or base): the latest chunks that each name (distinct, column name) stands for.

    A chunk that a name matches in several ways comes out once, as the first of these.
    """
    latest = latest_chunks(chunks)
    own = [F.struct(F.col("class_name").alias("name"), F.lit(0).alias("way")), F.struct(F.col("method_name").alias("name"), F.lit(1).alias("way"))]
    bases = F.transform(F.coalesce("base_types", F.array().cast("array<string>")), lambda b: F.struct(b.alias("name"), F.lit(2).alias("way")))
    held = latest.select("chunk_no", F.explode(F.concat(F.array(*own), bases)).alias("__h")).select("chunk_no", "__h.name", "__h.way").where("name <> ''")
    met = held.join(names.select("name").distinct(), "name").groupBy("name", "chunk_no").agg(F.min("way").alias("__way"))
    return met.select("name", "chunk_no", F.element_at(F.array(F.lit("class"), F.lit("method"), F.lit("base")), F.col("__way") + 1).alias("matched"))

"""Statements that run over lines, bindings of dependency injection in them, and graphs of assemblies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.keys import strip_blanks

# How a statement on a container begins; the forms of bindings (RE2 and Java alike); the calls that set a scope.
STATEMENT_START = r"\b[Cc]ontainer\s*(?:\.|$)"
BIND = r"\bBind<\s*([^<>]+?)\s*>\s*\(\s*\)\s*\.\s*To<\s*([^<>]+?)\s*>"
ONE_TYPE = {"BindInterfacesTo": r"\bBindInterfacesTo<\s*([^<>]+?)\s*>", "BindInterfacesAndSelfTo": r"\bBindInterfacesAndSelfTo<\s*([^<>]+?)\s*>", "DeclareSignal": r"\bDeclareSignal<\s*([^<>]+?)\s*>"}
FACTORY = r"\bBindFactory<\s*([^<>]+?)\s*,\s*([^<>,]+?)\s*>"
SCOPE = r"\.\s*(AsSingle|AsTransient|AsCached|NonLazy)\s*\(\s*\)"


def statements(texts: DataFrame, key: str, text: str, start: str = STATEMENT_START, end: str = ";") -> DataFrame:
    """key, line_number (from 1), statement: runs of lines from one that matches start to the next that holds end.

    A new start ends the statement before it; one without an end runs to the last line. Lines are joined by blanks,
    and what follows the end is left out. A running count over the lines of a text tells them apart.
    """
    lines = texts.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1)).alias("__at", "__line"))
    running = W.partitionBy(key).orderBy("__at").rowsBetween(W.unboundedPreceding, W.currentRow)
    begun = lines.withColumn("__no", F.sum(F.when(F.col("__line").rlike(start), 1).otherwise(0)).over(running)).where("__no > 0")
    before = W.partitionBy(key, "__no").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    open_lines = begun.withColumn("__ended", F.coalesce(F.max(F.contains("__line", F.lit(end)).cast("int")).over(before), F.lit(0))).where("__ended = 0")
    parts = F.sort_array(F.collect_list(F.struct("__at", F.trim("__line").alias("__line"))))
    made = open_lines.groupBy(key, "__no").agg((F.min("__at") + 1).alias("line_number"), F.array_join(F.transform(parts, lambda p: p["__line"]), " ").alias("__whole"))
    return made.select(key, "line_number", F.substring_index("__whole", end, 1).alias("statement"))


def bindings(statement_rows: DataFrame, key: str) -> DataFrame:
    """key, line_number, binding_type, interface_name, concrete_type, scope ('' if none) of statements that bind."""
    text = F.col("statement")
    group = lambda pattern, n: F.regexp_extract(text, pattern, n)
    forms = [F.when(text.rlike(BIND), F.struct(F.lit("Bind").alias("t"), group(BIND, 1).alias("i"), group(BIND, 2).alias("c")))]
    forms += [F.when(text.rlike(p), F.struct(F.lit(name).alias("t"), group(p, 1).alias("i"), group(p, 1).alias("c"))) for name, p in ONE_TYPE.items()]
    forms += [F.when(text.rlike(FACTORY), F.struct(F.lit("BindFactory").alias("t"), group(FACTORY, 2).alias("i"), group(FACTORY, 1).alias("c")))]
    made = statement_rows.withColumn("__b", F.coalesce(*forms)).where("__b is not null")
    return made.select(key, "line_number", F.col("__b.t").alias("binding_type"), F.col("__b.i").alias("interface_name"), F.col("__b.c").alias("concrete_type"), group(SCOPE, 1).alias("scope"))


def assembly_edges(references: DataFrame, assemblies: DataFrame) -> DataFrame:
    """name, reference: references of assemblies by name; those by guid (GUID:...) are resolved, unknown ones shortened.

    references has name and reference, assemblies has guid and name; of several names for a guid the least counts.
    """
    by_guid = F.lower(F.regexp_extract("reference", r"^GUID:\s*(\w+)$", 1))
    known = assemblies.where("guid <> ''").groupBy(F.lower("guid").alias("__guid")).agg(F.min("name").alias("__known"))
    asked = references.withColumn("reference", strip_blanks(F.col("reference"))).withColumn("__guid", by_guid)
    shown = F.coalesce("__known", F.concat(F.lit("["), F.substring("__guid", 1, 8), F.lit("...]")))
    return asked.join(known, "__guid", "left").select("name", F.when(F.col("__guid") == "", F.col("reference")).otherwise(shown).alias("reference")).distinct()


def most_referenced(edges: DataFrame, least: int = 0, k: int = 20) -> DataFrame:
    """name, n_dependents, dependents of the k assemblies that most others refer to (a top-k report); k of 0 gives all.

    Assemblies that only refer to others have none; ties fall to the name.
    """
    both = edges.select(F.col("reference").alias("n"), F.col("name").alias("d")).unionByName(edges.select(F.col("name").alias("n"), F.lit(None).cast("string").alias("d")))
    made = both.groupBy(F.col("n").alias("name")).agg(F.sort_array(F.collect_set("d")).alias("dependents"))
    kept = made.where(F.size("dependents") >= least).select("name", F.size("dependents").alias("n_dependents"), "dependents")
    return kept.orderBy(F.desc("n_dependents"), "name").limit(k) if k else kept

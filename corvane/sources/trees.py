"""Source trees as tables: scans with excludes, languages, modules, and what metadata files tell."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.keys import normal_guid
from corvane.operators.projections import without_prefixes

# Languages by the endings of files; folders that no scan looks into unless it is told to.
LANGUAGE_ENDINGS = {
    "csharp": ("cs",), "cpp": ("cpp", "cc", "cxx", "h", "hpp"), "python": ("py",), "javascript": ("js", "jsx", "mjs", "cjs"), "typescript": ("ts", "tsx"), "lua": ("lua",), "rust": ("rs",),
    "go": ("go",), "html": ("html", "htm", "vue"), "css": ("css", "scss", "less"), "markdown": ("md",), "json": ("json",), "yaml": ("yaml", "yml"), "unity": ("prefab", "unity", "asset"),
}
SKIPPED_FOLDERS = (".git", ".hg", ".svn", ".idea", ".vs", ".vscode", "__pycache__", "node_modules", "bin", "obj", "build", "dist", "target", "venv", ".venv", "Library", "Temp", "Logs")


@dataclass(frozen=True)
class Excludes:
    """Patterns to leave out, by their class: endings (*.x), folders (name/) and all others, which are globs of names or parts
    of paths."""

    endings: tuple[str, ...]
    folders: tuple[str, ...]
    others: tuple[str, ...]

    @classmethod
    def of(cls, patterns: Sequence[str]) -> Excludes:
        endings = tuple(p[1:] for p in patterns if p.startswith("*.") and "*" not in p[1:])
        folders = tuple(p.rstrip("/") for p in patterns if p.endswith("/"))
        return cls(endings, folders, tuple(p for p in patterns if p[1:] not in endings and p.rstrip("/") not in folders))

    def hit(self, path: Column) -> Column:
        """Whether a path with / is left out; compound endings like *.d.ts count as well."""
        name, folders = F.element_at(F.split(path, "/"), -1), F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
        tests = [F.lower(name).endswith(e.lower()) for e in self.endings]
        if self.folders:
            tests.append(F.arrays_overlap(folders, F.array(*map(F.lit, self.folders))))
        for other in self.others:
            if "*" in other:
                tests.append(name.rlike("^" + ".*".join(re.escape(x) for x in other.split("*")) + "$"))
            else:
                tests.append(path.contains(other))
        return reduce(lambda a, b: a | b, tests, F.lit(False))


def scan_tree(spark: SparkSession, root: str, repo: str, endings: list[str], skip: list[str] | None = None, excludes: Sequence[str] = ()) -> DataFrame:
    """repo, rel_path, modified_at, n_bytes, source of the files below root with one of the endings.

    Files below a folder named in skip, or that an exclude pattern hits, are left out. Listing and reading are Spark's;
    bytes that are no UTF-8 become replacement characters. A large file is one row, as everywhere in this library.
    """
    glob = "*.{" + ",".join(endings) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").removeprefix("file://") + "/"
    relative = F.substr(F.col("path"), F.locate(base, F.col("path")) + len(base))
    found = files.select(F.lit(repo).alias("repo"), relative.alias("rel_path"), F.col("modificationTime").alias("modified_at"), F.col("length").alias("n_bytes"), F.decode("content", "UTF-8").alias("source"))
    folders = F.slice(F.split("rel_path", "/"), 1, F.size(F.split("rel_path", "/")) - 1)
    return found.where(~F.arrays_overlap(folders, F.lit(skip or [""])) & ~Excludes.of(excludes).hit(F.col("rel_path")))


def scan_trees(spark: SparkSession, trees: Sequence[tuple[str, str, list[str], Sequence[str]]], skip: list[str] | None = None) -> DataFrame:
    """scan_tree over several trees of (repo, root, endings, excludes), with source_dir; a missing root is an error of Spark."""
    parts = [scan_tree(spark, root, repo, endings, skip, excludes).withColumn("source_dir", F.lit(root)) for repo, root, endings, excludes in trees]
    return reduce(DataFrame.unionByName, parts)


def language_of_path(path: Column) -> Column:
    """The language of a file by its ending, null for others."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return reduce(lambda rest, pair: F.when(ending.isin(*pair[1]), pair[0]).otherwise(rest), LANGUAGE_ENDINGS.items(), F.lit(None).cast("string"))


def source_folders(files: DataFrame, path: str = "rel_path", least: int = 2) -> DataFrame:
    """repo, language, n_files, folder: the languages of which a repository has so many files, with their deepest common folder.

    The common folder of sorted paths is that of the first and the last, so two values a language are enough. Paths through
    SKIPPED_FOLDERS don't count.
    """
    segments = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    kept = files.withColumn("language", language_of_path(F.col(path))).where(F.col("language").isNotNull() & ~F.arrays_overlap(F.concat(segments, F.array(F.lit(""))), F.array(*map(F.lit, SKIPPED_FOLDERS))))
    ends = kept.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n_files"), F.min(F.col(path)).alias("__a"), F.max(F.col(path)).alias("__b"))
    a, b = F.split("__a", "/"), F.split("__b", "/")
    alike = F.aggregate(
        F.sequence(F.lit(1), F.least(F.size(a), F.size(b))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
        lambda acc, i: F.struct((acc["n"] + F.when(acc["go"] & (F.element_at(a, i) == F.element_at(b, i)), 1).otherwise(0)).alias("n"), (acc["go"] & (F.element_at(a, i) == F.element_at(b, i))).alias("go")),
        lambda acc: acc["n"],
    )
    depth = F.least(alike, F.size(a) - 1, F.size(b) - 1)
    return ends.where(F.col("n_files") >= least).select("repo", "language", "n_files", F.array_join(F.slice(a, F.lit(1), depth), "/").alias("folder"))


def assign_folders(files: DataFrame, folders: DataFrame, path: str = "rel_path") -> DataFrame:
    """repo, path, folder: to which of the stated source folders (repo, folder, endings, place) each file belongs.

    Of the folders that a path begins with, those with the file's ending come first, then those of lesser place; files of
    none have a null folder. A path meets each of its own leading folders, by an equi-join, not each stated one.
    """
    parts = F.split(F.col(path), "/")
    leading = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    ending = F.lower(F.regexp_extract(F.col(path), r"\.([^./]+)$", 1))
    asked = files.select("repo", path, ending.alias("__ending"), F.explode(F.array_distinct(leading)).alias("folder"))
    met = asked.join(folders, ["repo", "folder"]).withColumn("__misses", (~F.array_contains("endings", F.col("__ending"))).cast("int"))
    best = met.groupBy("repo", path).agg(F.min(F.struct("__misses", "place", "folder")).getField("folder").alias("folder"))
    return files.select("repo", path).distinct().join(best, ["repo", path], "left").select("repo", path, "folder")


def modules_of(files: DataFrame, assemblies: DataFrame, prefixes: list[str], path: str = "rel_path") -> DataFrame:
    """repo, path, module: the assembly of the nearest folder above a file that has one, without prefixes; else the first
    folder of its path, else ''. assemblies has repo, folder and name."""
    parts = F.split(F.col(path), "/")
    leading = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder"), n.alias("depth")))
    asked = files.select("repo", path, F.explode(leading).alias("__l")).select("repo", path, "__l.folder", "__l.depth")
    near = asked.join(assemblies, ["repo", "folder"]).groupBy("repo", path).agg(F.max(F.struct("depth", "name")).getField("name").alias("__name"))
    first = F.when(F.size(parts) > 1, parts[0]).otherwise("")
    return files.select("repo", path).distinct().join(near, ["repo", path], "left").select("repo", path, F.coalesce(without_prefixes(F.col("__name"), prefixes), first).alias("module"))


def script_guids(metas: DataFrame, sources: DataFrame, path: str = "rel_path", text: str = "source") -> DataFrame:
    """guid, class_name, script_path, namespace: scripts by the guid in the file that stands beside them (x.cs.meta beside x.cs).

    The class is the name of the file, the namespace that of the script's first 4096 characters ('' without one). Of
    several scripts for a guid the one of greatest path counts. Files beside a script that isn't there give a row, too.
    """
    guid = normal_guid(F.regexp_extract(text, r"(?m)^guid: *([0-9a-fA-F]{32})", 1))
    meta = metas.where(F.col(path).endswith(".cs.meta")).select(guid.alias("guid"), F.regexp_replace(path, r"\.meta$", "").alias("script_path")).where("guid <> ''")
    space = F.regexp_extract(F.substring(text, 1, 4096), r"(?m)^[ \t]*namespace[ \t]+([\w.]+)", 1)
    spaces = sources.where(F.col(path).endswith(".cs")).select(F.col(path).alias("script_path"), space.alias("namespace"))
    both = meta.join(spaces, "script_path", "left").select("guid", F.regexp_extract("script_path", r"([^/]+)\.cs$", 1).alias("class_name"), "script_path", F.coalesce("namespace", F.lit("")).alias("namespace"))
    return both.groupBy("guid").agg(F.max(F.struct("script_path", "class_name", "namespace")).alias("__s")).select("guid", "__s.class_name", "__s.script_path", "__s.namespace")


def assembly_files(files: DataFrame, path: str = "rel_path", text: str = "source") -> DataFrame:
    """path, folder, name, references of assembly definitions (*.asmdef, JSON); other files and broken JSON give nothing."""
    parsed = files.where(F.col(path).endswith(".asmdef")).withColumn("__j", F.from_json(text, "name string, references array<string>")).where("__j.name is not null")
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    return parsed.select(F.col(path), folder.alias("folder"), F.col("__j.name").alias("name"), F.coalesce("__j.references", F.array().cast("array<string>")).alias("references"))


def installer_files(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """The C# files whose name holds installer, without regard to case."""
    return files.where(F.lower(F.regexp_extract(path, r"([^/]+)\.cs$", 1)).contains("installer"))


def project_info(files: DataFrame, path: str = "rel_path", text: str = "source") -> DataFrame:
    """repo, version, packages (name@version, sorted, joined), defines, scenes: what the settings of a project tell; N/A if missing."""
    held = lambda ending, value: F.max(F.when(F.col(path).endswith(ending), value))
    entries = F.map_entries(F.from_json(F.get_json_object(text, "$.dependencies"), "map<string,string>"))
    packages = F.array_join(F.sort_array(F.transform(entries, lambda e: F.concat(e["key"], F.lit("@"), e["value"]))), ", ")
    found = lambda pattern: F.nullif(F.array_join(F.regexp_extract_all(text, F.lit(pattern), 1), ", "), F.lit(""))
    made = files.groupBy("repo").agg(
        held("ProjectVersion.txt", found(r"(?m)^m_EditorVersion: *(\S+)")).alias("version"),
        held("manifest.json", packages).alias("packages"),
        held("ProjectSettings.asset", found(r"(?m)^ *scriptingDefineSymbols:[^\n]*\n *\w+: *(\S+)")).alias("defines"),
        held("EditorBuildSettings.asset", found(r"(?m)^ *path: *(\S+)")).alias("scenes"),
    )
    return made.select("repo", *(F.coalesce(c, F.lit("N/A")).alias(c) for c in ("version", "packages", "defines", "scenes")))


def newer_than(files: DataFrame, indexed: DataFrame, most_minutes: int = 30) -> DataFrame:
    """repo, n_newer, stale: how many files of a repository changed after it was indexed (repo, indexed_at), and whether the
    latest of these changes is more than so many minutes younger than the index, so that a new run is due."""
    both = files.join(indexed, "repo").where("modified_at > indexed_at")
    span = F.max(F.unix_timestamp("modified_at")) - F.min(F.unix_timestamp("indexed_at"))
    counted = both.groupBy("repo").agg(F.count(F.lit(1)).alias("n_newer"), (span > 60 * most_minutes).alias("stale"))
    return indexed.select("repo").distinct().join(counted, "repo", "left").select("repo", F.coalesce("n_newer", F.lit(0)).cast("bigint").alias("n_newer"), F.coalesce("stale", F.lit(False)).alias("stale"))


def in_order(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """files with their place within each repository by path."""
    return files.withColumn("place", F.row_number().over(W.partitionBy("repo").orderBy(path)))

"""Column expressions over chunks: identifiers, texts to embed, snippets, kinds of files, ages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.keys import normal_path

#: Characters of a text that is embedded or stored beside a vector.
MOST_CHARS = 5000


def chunk_id(file_path: Column, class_name: Column, method_name: Column, start_line: Column, end_line: Column) -> Column:
    """Path, class, method (if any) and lines in one name, joined by __."""
    path = F.replace(F.translate(file_path, "\\/", "__"), F.lit(":"), F.lit(""))
    return F.concat_ws("__", path, class_name, F.nullif(method_name, F.lit("")), F.concat(F.lit("L"), start_line.cast("string"), F.lit("-"), end_line.cast("string")))


def embedding_text(namespace: Column, class_name: Column, base_types: Column, file_path: Column, module: Column, doc_comment: Column, source: Column) -> Column:
    """Where a chunk stands, its documentation and its source, of MOST_CHARS code points at most."""
    bases = F.when(F.size(base_types) > 0, F.concat(F.lit(": "), F.array_join(base_types, ", ")))
    head = F.concat_ws(" ", F.nullif(namespace, F.lit("")), class_name, bases)
    place = F.concat(F.lit("File: "), F.coalesce(file_path, F.lit("")), F.when(module != "", F.concat(F.lit(" | Module: "), module)).otherwise(""))
    doc = F.when(doc_comment != "", F.concat(F.lit("\n"), doc_comment))
    return F.substring(F.concat_ws("\n", head, place, doc, F.lit(""), F.substring(F.coalesce(source, F.lit("")), 1, MOST_CHARS)), 1, MOST_CHARS)


def stored_metadata(chunks: DataFrame) -> DataFrame:
    """What is kept beside a vector: scalar columns, null texts empty, base types joined, source cut to MOST_CHARS."""
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("class_name", "method_name", "namespace", "chunk_type", "module", "doc_comment")]
    return chunks.select("repo", normal_path(F.col("file_path")).alias("file_path"), *texts, "start_line", "end_line", F.array_join("base_types", ",").alias("base_types"), F.substring("source", 1, MOST_CHARS).alias("source"))


def snippet(source: Column, lines: int = 20) -> Column:
    """The first lines of a text, with a last line that counts those left out."""
    parts = F.split(source, "\n", -1)
    head = F.array_join(F.slice(parts, 1, lines), "\n")
    return F.when(F.size(parts) > lines, F.concat(head, F.lit("\n... "), (F.size(parts) - lines).cast("string"), F.lit(" more"))).otherwise(source)


def trimmed_line(line: Column, most: int = 200) -> Column:
    """A line without surrounding blanks, cut to so many code points and three dots."""
    bare = F.regexp_replace(line, r"^\s+|\s+$", "")
    return F.when(F.length(bare) > most, F.concat(F.substring(bare, 1, most), F.lit("..."))).otherwise(bare)


def asset_kind(path: Column) -> Column:
    """prefab, scene or other, by the ending of a path."""
    low = F.lower(path)
    return F.when(low.endswith(".prefab"), "prefab").when(low.endswith(".unity"), "scene").otherwise("other")


def without_prefixes(name: Column, prefixes: list[str]) -> Column:
    """name without each of the prefixes, one after the other."""
    return reduce(lambda n, p: F.when(n.startswith(p), F.substr(n, F.lit(len(p) + 1))).otherwise(n), prefixes, name)


def age_text(seconds: Column) -> Column:
    """An age in whole hours from one hour on, else in minutes."""
    whole = lambda unit: F.floor(seconds / unit).cast("string")
    return F.when(seconds >= 3600, F.concat(whole(3600), F.lit("h"))).otherwise(F.concat(whole(60), F.lit("m")))


def matches_pattern(path: Column, pattern: str) -> Column:
    """Whether a path ends as a pattern like *.cs asks."""
    return path.endswith(pattern.lstrip("*"))


def aliased(repo: Column, aliases: dict[str, str]) -> Column:
    """The name that an alias stands for; other names stay."""
    return reduce(lambda rest, pair: F.when(repo == pair[0], pair[1]).otherwise(rest), aliases.items(), repo)

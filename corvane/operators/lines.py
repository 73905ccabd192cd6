"""Texts as numbered lines: sections between heading lines, blocks of comments, matches of symbols, languages of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def text_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line: every line of each text; line ends of any kind count, null texts have no lines."""
    lined = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1)
    return texts.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(lined).alias("__at", "line")).select(key, (F.col("__at") + 1).alias("line_no"), "line")


def line_sections(texts: DataFrame, key: str, text: str, mark: str, least_lines: int = 150, least_sections: int = 2) -> DataFrame:
    """key, start_line, end_line, title, n_chars: texts of least_lines or more, cut where a line matches mark.

    Each section runs from its line to the one before the next, without blank lines at its end; what stands before the
    first is left out. Texts that are shorter, or have fewer such lines, are one section from line 1, without a title.
    """
    lines = text_lines(texts, key, text)
    whole = W.partitionBy(key)
    heads = lines.withColumn("__head", F.col("line").rlike(mark)).withColumn("__no", F.sum(F.col("__head").cast("int")).over(whole.orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)))
    known = heads.withColumns({"__lines": F.count(F.lit(1)).over(whole), "__heads": F.sum(F.col("__head").cast("int")).over(whole)})
    cut = (F.col("__lines") >= least_lines) & (F.col("__heads") >= least_sections)
    placed = known.withColumn("__no", F.when(cut, F.col("__no")).otherwise(F.lit(-1))).where("__no <> 0")
    solid = F.max(F.when(F.trim("line") != "", F.col("line_no"))).over(W.partitionBy(key, "__no"))
    kept = placed.withColumn("__last", solid).where(F.col("line_no") <= F.coalesce("__last", F.col("line_no")))
    title = F.min_by(F.when(F.col("__no") > 0, F.col("line")), "line_no")
    return kept.groupBy(key, "__no").agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), title.alias("title"), (F.sum(F.length("line")) + F.count(F.lit(1)) - 1).alias("n_chars")
    ).drop("__no")


def comment_blocks(texts: DataFrame, key: str, text: str, mark: str) -> DataFrame:
    """key, start_line, end_line, n_lines: runs of neighbouring lines that match mark (gaps and islands)."""
    found = text_lines(texts, key, text).where(F.col("line").rlike(mark))
    island = F.col("line_no") - F.row_number().over(W.partitionBy(key).orderBy("line_no"))
    return found.withColumn("__island", island).groupBy(key, "__island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count(F.lit(1)).alias("n_lines")).drop("__island")


def symbol_lines(texts: DataFrame, key: str, text: str, symbols: list[str], whole_word: bool = True) -> DataFrame:
    """key, line_no, symbol, line, n_matches of the lines that hold one of the stated symbols, taken literally."""
    lines = text_lines(texts, key, text)
    quoted = lambda s: "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c for c in s)
    pattern = lambda s: rf"\b{quoted(s)}\b" if whole_word else quoted(s)
    counted = F.array(*(F.struct(F.lit(s).alias("symbol"), F.regexp_count("line", F.lit(pattern(s))).alias("n")) for s in symbols))
    held = lines.where(" or ".join("contains(line, '" + s.replace("\\", "\\\\").replace("'", "\\'") + "')" for s in symbols))
    found = held.withColumn("__s", F.explode(F.filter(counted, lambda x: x["n"] > 0)))
    return found.select(key, "line_no", F.col("__s.symbol").alias("symbol"), "line", F.col("__s.n").alias("n_matches"))


def is_minified(text: Column, most: int = 200) -> Column:
    """Whether the lines of a text hold more than so many bytes on average."""
    return F.octet_length(text) / F.size(F.split(text, "\n", -1)) > most


def is_small(text: Column, least_lines: int = 150) -> Column:
    """Whether a text has fewer lines than so many."""
    return F.size(F.split(text, "\n", -1)) < least_lines


def signature(text: Column) -> Column:
    """The head of a declaration: what stands before its body, in one line."""
    return F.trim(F.regexp_replace(F.regexp_extract(text, r"(?s)^(.*?)(?:\{|=>|$)", 1), r"\s+", " "))

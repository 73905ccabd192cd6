"""References to symbols in source lines, told apart into definitions and uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.corpus import TYPE_NAME, code_of_classes, latest_chunks
from corvane.operators.parsing import definitions


def class_lines(chunks: DataFrame) -> DataFrame:
    """repo, symbol, file_path, line_no: the lines that name a class of their repository.

    Lines are those of the latest chunks; a line that several chunks hold comes out once. Null sources, class names and
    start lines give nothing. Names are taken apart in the JVM and met with the classes by a join on the name, so the work
    follows the text, not the number of classes.
    """
    symbols = code_of_classes(chunks).select("repo", F.col("class_name").alias("symbol")).distinct()
    lines = latest_chunks(chunks).where("start_line is not null").select("repo", "file_path", "start_line", F.posexplode(F.split("source", r"\r\n|\r|\n")).alias("__at", "__line"))
    named = lines.select("repo", "file_path", (F.col("start_line") + F.col("__at")).alias("line_no"), F.explode(F.array_distinct(F.regexp_extract_all("__line", F.lit(f"({TYPE_NAME})")))).alias("symbol"))
    return named.join(symbols, ["repo", "symbol"], "left_semi").select("repo", "symbol", "file_path", "line_no").distinct()


def class_references(chunks: DataFrame) -> DataFrame:
    """class_lines with tag: DEF where the language's lexer finds the definition of the symbol in that line, else REF."""
    defined = definitions(chunks).select("repo", F.col("name").alias("symbol"), "file_path", "line_no", F.lit(True).alias("__def")).distinct()
    tagged = class_lines(chunks).join(defined, ["repo", "symbol", "file_path", "line_no"], "left")
    return tagged.select("repo", "symbol", "file_path", "line_no", F.when(F.col("__def"), "DEF").otherwise("REF").alias("tag"))

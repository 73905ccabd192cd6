"""Texts taken apart at their headings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heading_sections(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, position, level, title, section: each text cut before its lines of one to six # and a blank.

    The part before the first heading is at level 0 with an empty title. Line ends become \\n; null texts give no rows,
    empty ones one empty section. Together the sections of a text, joined by line ends, give it back.
    """
    lined = F.regexp_replace(text, r"\r\n?", "\n")
    parts = documents.where(F.col(text).isNotNull()).select(doc_id, F.posexplode(F.split(lined, r"\n(?=#{1,6} )")).alias("position", "section"))
    mark = F.regexp_extract("section", r"\A(#{1,6}) ", 1)
    return parts.select(doc_id, "position", F.length(mark).alias("level"), F.regexp_extract("section", r"\A#{1,6} +([^\n]*)", 1).alias("title"), "section")

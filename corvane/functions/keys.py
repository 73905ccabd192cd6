"""Normal forms of keys and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as a blank.
BLANKS = " \t\r\n"


def strip_blanks(value: Column) -> Column:
    """value without surrounding spaces, tabs and line ends."""
    return F.regexp_replace(value, r"\A[ \t\r\n]+|[ \t\r\n]+\z", "")


def normal_guid(value: Column) -> Column:
    """A guid without case, hyphens and surrounding blanks; null stays null."""
    return F.lower(F.replace(strip_blanks(value), F.lit("-"), F.lit("")))


def normal_label(value: Column) -> Column:
    """A label without case and surrounding blanks; null stays null."""
    return F.lower(strip_blanks(value))


def normal_path(value: Column) -> Column:
    """A path with `/` as separator and no leading `./`."""
    return F.regexp_replace(F.replace(value, F.lit("\\"), F.lit("/")), r"\A(?:\./+)+", "")

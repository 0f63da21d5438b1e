"""Words as native columns: maximal runs without ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(BLANKS))


def word_array(text: Column) -> Column:
    bare = trimmed(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def word_count(text: Column) -> Column:
    bare = trimmed(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long")

"""Small text clean-ups as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_dots(code: Column) -> Column:
    return F.replace(code, F.lit("."), F.lit(""))


def without_quotes(code: Column) -> Column:
    return F.replace(code, F.lit("'"), F.lit(""))


def underscored(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit("_"))

"""Age and category grouping as column expressions (no Python per row)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortweave.functions.text import underscored
from cohortweave.settings import ETHNICITY_GROUPS, GENDER_GROUPS, RACE_GROUPS

DAYS_PER_YEAR = 365.25


def birth_date(year: Column, month: Column) -> Column:
    """First day of the birth month; null when a part is missing or no month."""
    return F.when(month.between(1, 12), F.make_date(year, month, F.lit(1)))


def age_years(on: Column, born: Column, capped: Column | None = None, cap: int = 90) -> Column:
    """Age in whole years, rounded half up; ``cap`` where ``capped`` is true."""
    age = F.round(F.datediff(on, born) / F.lit(DAYS_PER_YEAR), 0)
    return age if capped is None else F.when(capped, F.lit(float(cap))).otherwise(age)


def grouped(
    value: Column, groups: Mapping[str, Sequence[str]], null_group: str | None = None
) -> Column:
    """Replace each listed value by its group name; other values stay."""
    rules = [(value.isin(*members), name) for name, members in groups.items()]
    if null_group is not None:
        rules.append((value.isNull(), null_group))
    (first, name), *rest = rules
    chain = reduce(lambda acc, rule: acc.when(rule[0], rule[1]), rest, F.when(first, name))
    return underscored(chain.otherwise(value))


def race_group(value: Column) -> Column:
    return grouped(value, RACE_GROUPS, null_group="Unknown")


def ethnicity_group(value: Column) -> Column:
    return grouped(value, ETHNICITY_GROUPS)


def gender_group(value: Column) -> Column:
    return grouped(value, GENDER_GROUPS)

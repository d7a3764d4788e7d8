"""Category recoding and timing relative to the index date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortweave.settings import CohortSettings


def recoded_category(category: Column, concept_id: Column, settings: CohortSettings) -> Column:
    """First matching rule wins: category prefix, then concept, else unchanged."""
    rules = [
        (category.startswith(prefix), label)
        for prefix, label in settings.category_prefixes.items()
    ] + [(concept_id == concept, label) for concept, label in settings.category_by_concept.items()]
    if not rules:
        return category
    (first, label), *rest = rules
    chain = reduce(lambda acc, rule: acc.when(rule[0], rule[1]), rest, F.when(first, label))
    return chain.otherwise(category)


def usable_category(category: Column, settings: CohortSettings) -> Column:
    return category.isNotNull() & (category != settings.unusable_category)


def pre_or_post(day: Column, index_date: Column) -> Column:
    """``pre`` strictly before the index date, else ``post`` (also when unknown)."""
    return F.when(day < index_date, "pre").otherwise("post")

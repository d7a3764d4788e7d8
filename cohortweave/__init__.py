"""Cohort feature engineering on Spark DataFrames."""

from cohortweave.settings import DEFAULT_SETTINGS, CohortSettings

__all__ = ["CohortSettings", "DEFAULT_SETTINGS"]

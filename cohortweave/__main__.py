"""Run the whole build: ``python -m cohortweave RELEASE OUTPUT``."""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import SparkSession

from cohortweave.operators.boosting import N_TREES
from cohortweave.plans.build import STEPS, CohortBuild
from cohortweave.session import drop_materialized, folder_bytes, size_shuffles, use_folder
from cohortweave.settings import DEFAULT_SETTINGS
from cohortweave.sources.tables import load_release, write_table


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cohortweave", description=__doc__)
    parser.add_argument("release", help="folder with the input tables")
    parser.add_argument("output", help="new folder for the results")
    parser.add_argument("--format", choices=("csv", "parquet"), default="csv")
    parser.add_argument("--steps", nargs="*", default=["cohort", "model_matrix"], choices=STEPS)
    parser.add_argument("--rare-persons", type=int, default=DEFAULT_SETTINGS.rare_min_persons)
    parser.add_argument("--trials", type=int, default=DEFAULT_SETTINGS.trials)
    parser.add_argument("--trees", type=int, default=N_TREES)
    parser.add_argument("--features-only", action="store_true", help="fit no model")
    parser.add_argument("--input-bytes", type=int, help="input size for the shuffles (default: measured)")
    options = parser.parse_args(arguments)

    spark = SparkSession.builder.getOrCreate()
    size_shuffles(spark, options.input_bytes or folder_bytes(spark, options.release))
    use_folder(spark, f"{options.output.rstrip('/')}/_work")
    settings = dataclasses.replace(
        DEFAULT_SETTINGS, rare_min_persons=options.rare_persons, trials=options.trials, trees=options.trees
    )
    build = CohortBuild(load_release(spark, options.release, options.format), settings)
    build.save(options.output, options.steps)
    if not options.features_only:
        result = build.predict()
        for name in ("trials", "model", "scores", "importance"):
            write_table(getattr(result, name), f"{options.output.rstrip('/')}/{name}")
    drop_materialized(spark)


if __name__ == "__main__":
    main()

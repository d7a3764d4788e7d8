import os
import sys

import pyarrow as pa
import pytest
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers import the package too
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from cohortweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8, shuffle_partitions=2)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """frame("a int, b string", rows) -> DataFrame over a local table.

    Going through Arrow avoids a job of several tasks per tiny table.
    """

    def make(schema, rows):
        declared = T.StructType.fromDDL(schema)
        arrow = to_arrow_schema(declared)
        columns = list(zip(*rows)) or [[] for _ in declared]
        arrays = [pa.array(c, type=f.type) for c, f in zip(columns, arrow)]
        return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), declared)

    return make


def rows_of(df, *columns):
    """Rows as sorted tuples; nulls sort first."""
    picked = df.select(*columns) if columns else df
    return sorted(
        (tuple(r) for r in picked.collect()),
        key=lambda row: [(v is not None, v) for v in row],
    )

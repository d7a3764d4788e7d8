import pytest
from conftest import rows_of

from cohortweave import session


@pytest.fixture
def sql_settings(spark):
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


def test_shuffles_grow_with_the_input(sql_settings):
    assert session.size_shuffles(sql_settings, 1) == 8  # the session's cores
    assert session.size_shuffles(sql_settings, 100 << 30) == 800
    assert session.size_shuffles(sql_settings, 100 << 40) == 100 << 13
    assert sql_settings.conf.get("spark.sql.shuffle.partitions") == str(100 << 13)


def test_folder_size(spark, tmp_path):
    (tmp_path / "part").mkdir()
    (tmp_path / "part" / "a").write_bytes(b"x" * 1000)
    assert session.folder_bytes(spark, str(tmp_path)) == 1000


def test_materialize_reads_from_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    df = spark.range(5).selectExpr("id", "id * 2 AS twice")
    stored = session.materialize(df, "numbers")
    assert rows_of(stored) == rows_of(df) and stored.dtypes == df.dtypes
    assert all(f"{tmp_path}/numbers-" in f for f in stored.inputFiles())


def test_bucketed_tables_join_without_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    left = spark.range(50).selectExpr("id % 7 AS k", "id AS a")
    right = spark.range(20).selectExpr("id AS k", "id * 2 AS b")
    stored = [session.materialize_bucketed(df, "side-by-side", ["k"], 3) for df in (left, right)]
    joined = stored[0].hint("merge").join(stored[1], "k", "left")
    assert rows_of(joined) == rows_of(left.join(right, "k", "left"))
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    one = stored[0].hint("merge").join(right, "k")
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


class Cluster:
    """Stands for a session on a cluster that names no checkpoint directory."""

    class conf:
        get = staticmethod(lambda name, default=None: default)

    class sparkContext:
        master, applicationId = "yarn", "app-1"
        getCheckpointDir = staticmethod(lambda: None)


def test_a_cluster_without_shared_folder_is_an_error(monkeypatch):
    frame = type("Frame", (), {"sparkSession": Cluster})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.materialize(frame, "numbers")
    monkeypatch.setattr(session, "_folders", {})
    session.use_folder(Cluster, "hdfs://x/work")
    assert session.shared_folder(Cluster) == "hdfs://x/work"


def test_materialized_files_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(session, "_written", {})
    session.materialize(spark.range(5), "numbers")
    assert len(list(tmp_path.iterdir())) == 1
    session.drop_materialized(spark)
    assert not list(tmp_path.iterdir())

"""Session building and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_folders: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def build_session(
    app_name: str = "cohortweave", cores: int | str = "*", shuffle_partitions: int | None = None
) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """Size of all files below a folder, as its file system counts them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(path).getLength()


def size_shuffles(spark: SparkSession, input_bytes: int, target_bytes: int = 128 << 20) -> int:
    """Set the number of shuffle partitions for inputs of a given size.

    Meant for a cluster run over large tables: enough partitions that each fits
    in memory even if nothing is reduced before the shuffle, and adaptive
    execution to merge the small ones that the reductions leave.
    """
    wanted = -(-input_bytes // target_bytes)
    partitions = max(spark.sparkContext.defaultParallelism, wanted)
    for name, value in {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_bytes),
    }.items():
        spark.conf.set(name, value)
    return partitions


def shared_folder(spark: SparkSession) -> str | None:
    """Folder every executor can reach, or None when nothing names one.

    The cluster's own ``spark.checkpoint.dir`` (or the directory already set on
    the context) always wins, then the folder given to ``use_folder``.  A
    temporary folder is made only in local mode, where driver and executors
    share one machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if context.applicationId not in _folders:
        if not context.master.startswith("local"):
            return None
        _folders[context.applicationId] = tempfile.mkdtemp(prefix="cohortweave-")
    return _folders[context.applicationId]


def use_folder(spark: SparkSession, folder: str) -> None:
    """Name a folder that driver and executors share, for clusters that name none."""
    _folders[spark.sparkContext.applicationId] = folder


def drop_materialized(spark: SparkSession) -> None:
    """Delete what this application's ``materialize`` wrote; call it when all results are stored.

    The folder of ``use_folder`` is forgotten, and removed if nothing else lies there.
    """
    application = spark.sparkContext.applicationId

    def files(name: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    for name in _written.pop(application, []):
        path, system = files(name)
        system.delete(path, True)
    if application in _folders:
        path, system = files(_folders.pop(application))
        if system.exists(path) and not len(system.listStatus(path)):
            system.delete(path, False)


def ensure_checkpoint_dir(spark: SparkSession) -> bool:
    """Give the context a checkpoint directory if a shared folder is known."""
    if spark.sparkContext.getCheckpointDir():
        return True
    folder = shared_folder(spark)
    if folder:
        spark.sparkContext.setCheckpointDir(folder)
    return folder is not None


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted by ``drop_materialized``."""
    folder = shared_folder(spark)
    if folder is None:
        raise RuntimeError(
            "no folder that all executors share: set spark.checkpoint.dir or call use_folder()"
        )
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def constant_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A few fixed rows as a plan of literals; ``createDataFrame`` would start Python workers."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema, strict=True)])
        for row in rows
    ]
    return spark.range(1, numPartitions=1).select(
        F.inline(F.array(*structs).cast(T.ArrayType(schema)))
    )


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    One write is cheaper than ``checkpoint()`` (which runs its last stage
    twice), stays columnar so later steps still prune columns, and survives the
    loss of executors.  A cluster without a shared folder is an error: the plan
    would be computed again by every reader.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Like ``materialize``, bucketed and sorted by some columns.

    Joins and groupings by these columns read the files where they lie: only the other side of such a join
    is shuffled, and two tables with equal buckets need no shuffle at all.  The
    default number of buckets is that of the shuffle partitions.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        raise RuntimeError(
            "no folder that all executors share: set spark.checkpoint.dir or call use_folder()"
        )
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{folder.rstrip('/')}/{table}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.table(table)

"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

TASK_ROWS = 1 << 15  # input rows behind one shuffle partition
TASK_BYTES = "16m"  # shuffled bytes that adaptive execution gives one task
PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
WHOLE_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"

_staged: dict[tuple[str, str], Callable[[], DataFrame]] = {}
_built: dict[tuple[str, str], DataFrame] = {}
_sized: set[tuple[str, str]] = set()
_rows: dict[str, int] = {}
_local_folders: dict[str, str] = {}


def get_spark(app: str = "iotrail", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume (UTC clock, AQE on)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of its own; a cluster
    must name storage that survives the loss of an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to shared storage before staging tables")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="iotrail-")
    return _local_folders[application]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Unlike ``persist`` the result survives executor loss, and unlike
    ``checkpoint`` the re-read is columnar, so later stages still prune.
    """
    spark = df.sparkSession
    path = os.path.join(workspace(spark), f"{name}-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.parquet(path)
    staged = spark.read.schema(schema).parquet(path)
    staged._staged_path, staged._staged_table = path, None
    return staged


def stage_dealt(df: DataFrame, name: str, by: Sequence[str], placed: bool = False, order: Sequence[str] = ()) -> DataFrame:
    """:func:`stage` with the rows dealt into :func:`buckets` by some columns and sorted by them, then by ``order``.

    Joins, windows and groupings by those columns, or by more, read the table without a
    shuffle.  ``placed`` says that the rows of a task of ``df`` are already dealt so, and spares
    the shuffle before the write; where that is not true there are only more files.
    """
    spark = df.sparkSession
    path = os.path.join(workspace(spark), f"{name}-{uuid.uuid4().hex}")
    n, table = buckets(spark), f"iotrail_{uuid.uuid4().hex}"
    dealt = df if placed else df.repartition(n, *by)
    whole = spark.conf.get(WHOLE_KEYS, "true")
    spark.conf.set(WHOLE_KEYS, "false")  # joins by more columns than the tables are dealt by need no shuffle either
    try:
        dealt.write.format("parquet").bucketBy(n, *by).sortBy(*by, *order).option("path", path).saveAsTable(table)
    finally:
        spark.conf.set(WHOLE_KEYS, whole)
    staged = spark.table(table)
    staged._staged_path, staged._staged_table = path, table
    return staged


def release(staged: DataFrame) -> None:
    """Remove a staged table that a later generation has replaced."""
    path = getattr(staged, "_staged_path", None)
    if path:
        target = staged.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(staged.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def union_dealt(parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Rows of all parts; parts dealt alike by ``by`` stay dealt, which Spark sees where the keys of each part are named anew."""
    out = None
    for part in parts:
        part = part.select(*[F.col(c).alias(c) if c in by else F.col(c) for c in part.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def staged_once(spark: SparkSession, key: str, build, by: Sequence[str] | None = None, placed: bool = False, order: Sequence[str] = ()) -> DataFrame:
    """Stage ``build()`` the first time ``key`` is asked for in this application."""
    slot = (spark.sparkContext.applicationId, key)
    if slot not in _staged:
        staged = stage_dealt(build(), "table", by, placed, order) if by else stage(build(), "table")
        schema, path, table = staged.schema, staged._staged_path, staged._staged_table
        _staged[slot] = lambda: spark.table(table) if table else spark.read.schema(schema).parquet(path)
    return _staged[slot]()


def built_once(spark: SparkSession, key: str, build) -> DataFrame:
    """Keep ``build()`` for the application; it must be a narrow view of written tables."""
    slot = (spark.sparkContext.applicationId, key)
    if slot not in _built:
        _built[slot] = build()
    return _built[slot]


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle: the session's number, or more after :func:`spread`."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(PARTITIONS, "1")))


def buckets(spark: SparkSession) -> int:
    """Parts of a table that is dealt by a key: one for every ``TASK_ROWS`` input rows, at least one a core."""
    return max(spark.sparkContext.defaultParallelism, -(-_rows.get(spark.sparkContext.applicationId, 0) // TASK_ROWS))


def spread(spark: SparkSession, rows: int) -> None:
    """Let shuffles have a partition for every ``TASK_ROWS`` input rows, if that is more than the session's number.

    With a fixed number the sorts of a task grow with the input until they spill.  Adaptive
    execution joins partitions that turn out small, up to ``TASK_BYTES`` as shuffled, which
    compressed repetitive records multiply many times in memory.  Streams keep their own number.
    """
    app = spark.sparkContext.applicationId
    _rows[app] = max(_rows.get(app, 0), rows)
    wanted = -(-rows // TASK_ROWS)
    if wanted > shuffle_width(spark):
        spark.conf.set(PARTITIONS, str(wanted))
        if spark.conf.get(ADVISORY, "64m") == "64m":
            spark.conf.set(ADVISORY, TASK_BYTES)


def spread_for(table: DataFrame, name: str) -> DataFrame:
    """:func:`spread` for a stored table, whose rows are counted once per application from its footers."""
    spark = table.sparkSession
    slot = (spark.sparkContext.applicationId, name)
    if slot not in _sized:
        spread(spark, table.count())
        _sized.add(slot)
    return table

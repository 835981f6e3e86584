"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "foliant", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests, the bench and ad-hoc work; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


#: Bytes of an Arrow batch of packages, pages or pieces of them; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker is given at once, however many rows a partition has."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is missing, a local session gets a temporary folder of
    its own; a cluster session is refused, since executors would not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
        path = path.rsplit("/", 1)[0] if path else None
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="foliant-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir().rsplit("/", 1)[0]
    return path.rstrip("/")


#: Scratch paths of this driver that still exist; what is left goes when the driver ends.
_SCRATCH: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder. It goes with discard(), or when the driver's program ends."""
    if not _SCRATCH:
        atexit.unregister(discard_all)
        atexit.register(discard_all)
    path = f"{shared_dir(spark)}/foliant-{name}-{uuid.uuid4().hex}"
    _SCRATCH[path] = spark
    return path


#: Whether a query's shuffle files go with its end; else they stay until the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: the lineage is cut, and what was shuffled for it is deleted."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    said = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        if said is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, said)
    back = spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    back._scratch = path
    return back


#: Joins broadcast no table because its file is small: keys take a byte a row or less in a file, and some hundred in the hash
#: table that the driver makes. What counts is the bytes of the rows, once they were shuffled.
BY_ROWS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "2MB"}


def written_by_rows(df: DataFrame, name: str) -> DataFrame:
    """The same, with no broadcast whose rows were not measured: the driver's memory does not grow with the tables."""
    conf = df.sparkSession.conf
    said = {k: conf.get(k, None) for k in BY_ROWS}
    for k, v in BY_ROWS.items():
        conf.set(k, v)
    try:
        return written(df, name)
    finally:
        for k, v in said.items():
            if v is None:
                conf.unset(k)
            else:
                conf.set(k, v)


def discard(*what: DataFrame | str) -> None:
    """Delete written tables (or scratch paths) that no later job reads: those made from them are written themselves."""
    for x in what:
        path = x if isinstance(x, str) else x._scratch
        if spark := _SCRATCH.pop(path, None):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_made(since: set[str] = frozenset()) -> set[str]:
    """The scratch paths that exist and are not in `since`."""
    return set(_SCRATCH) - set(since)


def discard_all() -> None:
    for path in list(_SCRATCH):
        try:
            discard(path)
        except Exception:  # the session has stopped: nothing can be reached any more
            _SCRATCH.pop(path, None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

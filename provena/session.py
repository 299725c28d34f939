"""Session construction and the few settings every plan relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


def build(master: str | None = None, app: str = "provena", **conf: str) -> SparkSession:
    """A session with AQE on and UTC pinned; `conf` keys use `__` for dots.

    `master` is left to spark-submit when None.  Sizes that depend on the cluster
    (memory, partition bytes) belong to the deployment and are not set here.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only a local session, as in tests, may leave it unset; a cluster's executors don't see the driver's disk.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return place or f"{tempfile.gettempdir()}/provena-checkpoints"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def app_folder(spark: SparkSession) -> str:
    """The application's own part of the shared folder; it goes when the application ends."""
    path = f"{shared_folder(spark)}/provena-{spark.sparkContext.applicationId}"
    fs, where = _files(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def run_folder(spark: SparkSession) -> str:
    """The folder of the innermost `scratch` of this thread or task, or the application's."""
    return _scratch.get() or app_folder(spark)


#: Each thread has its own, so runs side by side don't store into each other's folders.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables stored inside go at the end; what is returned from inside must be stored `outside`."""
    path = f"{run_folder(spark)}/scratch-{uuid.uuid4().hex[:12]}"
    before = _scratch.set(path)
    try:
        yield path
    finally:
        _scratch.reset(before)
        discard(spark, path)


def stamp(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Files, bytes and the newest change of a table's folder or file, to see whether it has changed."""
    fs, where = _files(spark, path)
    files, size, newest = 0, 0, 0
    todo = fs.listFiles(where, True)
    while todo.hasNext():
        f = todo.next()
        files, size, newest = files + 1, size + f.getLen(), max(newest, f.getModificationTime())
    return files, size, newest


def discard(spark: SparkSession, path: str | None) -> None:
    """Remove a stored table or folder."""
    if path:
        fs, where = _files(spark, path)
        fs.delete(where, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder; it survives lost executors.

    A checkpoint folder that the application has set is left as it is.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(named or f"{run_folder(df.sparkSession)}/checkpoints")
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a dataset folder; the path may be in any Hadoop file system."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Removes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing: list[str] = []
_lock = Lock()


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go with each write; a setting of the application's own stays.

    Only for writes: a frame that is collected twice would look for its first run's files.
    """
    with _lock:
        mine = bool(_writing) or spark.conf.get(_CLEANUP, None) is None
        if mine:
            _writing.append(_CLEANUP)
            spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            if mine:
                _writing.pop()
                if not _writing:
                    spark.conf.unset(_CLEANUP)


def stored(df: DataFrame, outside: str | None = None) -> DataFrame:
    """Cut lineage by a compressed table in the run's folder; smaller than a checkpoint for wide rows.

    `outside` names a path that is not the scratch folder's.
    """
    path = outside or f"{run_folder(df.sparkSession)}/table-{uuid.uuid4().hex[:12]}"
    with shuffles_end(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of one Arrow batch, so that a Python worker holds little at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to what tasks over long texts need; lower settings stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)

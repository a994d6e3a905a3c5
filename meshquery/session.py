"""Sessions: sensible settings for local use, and the package's code for executors that don't have it."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import SparkSession

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_shipped: set[str] = set()
_collecting: ContextVar[list[str] | None] = ContextVar("collecting", default=None)  # of this thread: others' folders stay


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine; an existing one is returned as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application; Python workers unpickle its functions by name.

    Also keeps the batches that go to Python small, so that a worker's memory doesn't hang on the texts' lengths.
    """
    sc = spark.sparkContext
    if spark.conf.get(ARROW_BYTES) == "67108864b":  # the default: too much where texts stand in several columns
        spark.conf.set(ARROW_BYTES, "2m")
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix=f"{root.name}-code-"), f"{root.name}.zip")  # stays while the driver serves it
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; our own only where none is set (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="meshquery-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def checkpointed(df):
    """``df`` stored reliably, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df):
    """``df`` stored as Parquet in the shared folder: smaller than a checkpoint, its size is known to the planner, and only the columns asked for are read."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    if (paths := _collecting.get()) is not None:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The folders that :func:`kept` writes meanwhile, to be removed once nothing reads them."""
    paths: list[str] = []
    before = _collecting.set(paths)
    try:
        yield paths
    finally:
        _collecting.reset(before)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for what is run meanwhile."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def open_writers(spark: SparkSession, most: int = 32) -> Iterator[None]:
    """Tasks write up to ``most`` partitions at once instead of sorting their rows by partition, which spills; beyond that they sort."""
    with setting(spark, WRITERS, str(most)):
        yield

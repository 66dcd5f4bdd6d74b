"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, name: str = "bandweave", **conf) -> SparkSession:
    """Session for tests and benches on one machine; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.files.maxPartitionBytes", "2m")  # small test files still give every core a task
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_test_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the one the cluster names in spark.checkpoint.dir.

    Only where that setting is missing, as in tests, a temporary folder takes its place.
    """
    global _test_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _test_folder is None:
        _test_folder = tempfile.mkdtemp(prefix="bandweave-")
        atexit.register(shutil.rmtree, _test_folder, ignore_errors=True)
    return _test_folder


def ship_package(spark: SparkSession) -> None:
    """Let workers import this package wherever they start, for sessions that were not given it by --py-files."""
    root = os.path.dirname(os.path.abspath(__file__))
    if spark.conf.get("spark.bandweave.shipped", None) is None:
        folder = tempfile.mkdtemp(prefix="bandweave-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/bandweave", "zip", os.path.dirname(root), "bandweave"))
        spark.conf.set("spark.bandweave.shipped", "true")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_written: list[str] | None = None  # folders of the tables that `materialize` writes, while `temporary_tables` wants to know


@contextlib.contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that `materialize` writes inside, but for the last, which alone may be read afterwards."""
    global _written
    outer, _written = _written, []
    try:
        yield
        for path in _written[:-1]:
            _delete(spark, path)
        if outer is not None:
            outer += _written[-1:]
    finally:
        _written = outer


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "stage", clean: bool = False, codec: str | None = None) -> DataFrame:
    """Write a table that several later jobs read, and go on from the written files.

    With `clean`, Spark deletes the shuffle files of the write when it has ended, not when the driver next collects garbage.
    `codec`: how the files are compressed where not as the session says; zstd makes texts smaller.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    if clean:
        spark.conf.set(CLEANUP, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        if clean:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    if _written is not None:
        _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table that `materialize` wrote, once no later job reads it; other tables are left alone."""
    spark = df.sparkSession
    files = df.inputFiles()
    folder = files[0].rsplit("/", 1)[0] if files else ""
    if f"/{shared_folder(spark).rsplit('/', 1)[-1]}/" not in folder:
        raise ValueError(f"not a table in the shared folder: {folder or 'no files'}")
    _delete(spark, folder)

"""CSV and Parquet sources and sinks of the workload, all with declared schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandweave import TARGETS

TARGET_SCHEMA = "sample_index bigint, P double, K double, Mg double, pH double"
WAVELENGTH_SCHEMA = "band_no int, wavelength double"


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TARGET_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)


def read_wavelengths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WAVELENGTH_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    return read_targets(spark, path)


def write_submission(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Sample order, header, the five columns. One file on demand; else each part carries the header."""
    rows = df.select("sample_index", *TARGETS)
    if single_file:
        rows = rows.coalesce(1).sortWithinPartitions("sample_index")
    else:
        rows = rows.orderBy("sample_index")
    rows.write.option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Add rows to an experiment log; the column names are kept with the data, and columns follow the order of the log."""
    try:
        header = df.sparkSession.read.option("header", True).csv(path).columns
    except AnalysisException:  # no log yet
        header = df.columns
    if sorted(header) != sorted(df.columns):
        raise ValueError(f"the log has columns {header}, the rows have {df.columns}")
    df.select(*header).write.mode("append").option("header", True).csv(path)


def cached(df: DataFrame, path: str) -> DataFrame:
    """Read the table at `path`; compute and write it first where it is missing."""
    spark = df.sparkSession
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        df.write.mode("ignore").parquet(path)
        stored = spark.read.parquet(path)
    if stored.dtypes != df.dtypes:
        raise ValueError(f"{path} holds {stored.dtypes}, not {df.dtypes}")
    return stored


def save_eval(df: DataFrame, path: str, model: str, run_id: str) -> None:
    """Truth, prediction and baseline of a run, in one folder per model and run."""
    marked = df.withColumns({"model": F.lit(model), "run_id": F.lit(run_id)})
    # A run that is saved again takes the place of its first rows.
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "run_id").parquet(path)

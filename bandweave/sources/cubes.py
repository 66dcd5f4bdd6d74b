"""Image cubes in .npz files and class folders."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandweave.functions.text import key_from_path


PIXELS = "sample_index bigint, band int, x bigint, y bigint, value double, masked boolean"
CHUNK = 1 << 20


def _pixel_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decode one file at a time and hand its pixels on in chunks."""
    for batch in batches:
        for key, content in zip(batch.column("sample_index"), batch.column("content")):
            with np.load(io.BytesIO(content.as_py())) as cube:
                data, mask = cube["data"], cube["mask"].astype(bool)
            bands, height, width = data.shape
            for start in range(0, data.size, CHUNK):
                at = np.arange(start, min(start + CHUNK, data.size))
                band, rest = np.divmod(at, height * width)
                x, y = np.divmod(rest, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), key.as_py(), dtype=np.int64)),
                        pa.array(band.astype(np.int32)),
                        pa.array(x),
                        pa.array(y),
                        pa.array(data.ravel()[at].astype(np.float64)),
                        pa.array(mask.ravel()[at]),
                    ],
                    names=["sample_index", "band", "x", "y", "value", "masked"],
                )


def decode_cubes(files: DataFrame) -> DataFrame:
    """(path, content) rows to the long pixel table; the key is the integer base name."""
    keyed = files.select(key_from_path(F.col("path")).alias("sample_index"), "content")
    return keyed.mapInArrow(_pixel_batches, PIXELS)


def ingest_cubes(spark: SparkSession, path: str) -> DataFrame:
    return decode_cubes(spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path))


def class_labels(files: DataFrame) -> DataFrame:
    """Class from the parent folder and its 0-based place among the sorted class names."""
    named = files.withColumn("class", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    classes = named.select("class").distinct()
    numbered = classes.withColumn("label", (F.dense_rank().over(Window.orderBy("class")) - 1).cast("int"))
    return named.join(numbered, "class").select("path", "class", "label")


def scan_class_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files of <class>/<file> folders; only paths are read, not contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return class_labels(files.select("path"))

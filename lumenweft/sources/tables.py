"""Readers and sinks: parquet tables, CSV files, UTF-16 questionnaires, .npy arrays, NIfTI images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def questionnaires(spark: SparkSession, paths: str | list[str], schema: str, encoding: str = "UTF-16") -> DataFrame:
    """CSV files of one cohort, unioned. UTF-16 needs multiLine, else rows are split inside characters."""
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).option("multiLine", True).option("recursiveFileLookup", True).csv(paths)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV files with a header, in UTF-8; empty fields are null."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, one per task; nulls are empty fields, empty texts are quoted."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", '""').option("escape", '"').csv(path)


def file_catalog(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path and length of the files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length")


def npy_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """path, i, j, value of two-dimensional .npy files (one-dimensional ones have j = 0)."""
    import io

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a.reshape(a.shape[0], -1).astype(np.float64)
                i, j = np.indices(a.shape)
                yield pd.DataFrame({"path": path, "i": i.ravel(), "j": j.ravel(), "value": a.ravel()})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInPandas(decode, "path string, i long, j long, value double")


#: NumPy types by the datatype number of a NIfTI-1 header; fixed values of the format.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def nifti_volumes(content: bytes) -> Iterator[np.ndarray]:
    """The three-dimensional volumes of a NIfTI-1 file (gzipped or not), scaled as its header says."""
    import gzip
    import struct

    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    order = next((o for o in "<>" if len(data) >= 348 and struct.unpack(f"{o}i", data[:4])[0] == 348), None)
    if order is None:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack(f"{order}8h", data[40:56])
    code, (offset, slope, inter) = struct.unpack(f"{order}h", data[70:72])[0], struct.unpack(f"{order}3f", data[108:120])
    if code not in NIFTI_TYPES:
        raise ValueError(f"NIfTI datatype {code} isn't read")
    shape = [max(1, d) for d in (list(dim[1 : 1 + dim[0]]) + [1, 1, 1])[:3]]
    kind, size = np.dtype(order + NIFTI_TYPES[code]), int(np.prod(shape))
    for k in range(int(np.prod([max(1, d) for d in dim[4 : 1 + dim[0]]]))):
        volume = np.frombuffer(data, kind, size, int(offset) + k * size * kind.itemsize).reshape(shape, order="F").astype(np.float64)
        yield volume * slope + inter if slope else volume


def nifti_voxels(spark: SparkSession, folder: str, pattern: str = "*.nii*") -> DataFrame:
    """path, t, x, y, z, value of the NIfTI files below a folder; a task holds one file and one volume's rows at a time."""

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                for t, volume in enumerate(nifti_volumes(content)):
                    x, y, z = np.indices(volume.shape)
                    yield pd.DataFrame({"path": path, "t": t, "x": x.ravel(), "y": y.ravel(), "z": z.ravel(), "value": volume.ravel()})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInPandas(decode, "path string, t int, x int, y int, z int, value double")


def write_resumable(df: DataFrame, path: str, *partitions: str) -> None:
    """Parquet, replacing only the partitions that ``df`` holds, so that a run that stopped can go on."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def unfinished(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work items without an output yet."""
    return work.join(done.select(key), key, "left_anti")


def status(df: DataFrame, ok) -> DataFrame:
    """Adds status: ok or error, so that failed items stay in sight."""
    return df.withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("error"))

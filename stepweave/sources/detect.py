"""What kind of recording a path is."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IngestError

#: Formats by ending, and the first bytes of HDF5 files.
ENDINGS = {".mcap": "mcap", ".hdf5": "hdf5", ".h5": "hdf5", ".parquet": "parquet"}
HDF5_MAGIC = b"\x89HDF\r\n\x1a\n"


def format_of(path: Column) -> Column:
    """By the ending, whatever its case; unknown for others."""
    end = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = F.lit("unknown")
    for ending, name in ENDINGS.items():
        out = F.when(end == ending, name).otherwise(out)
    return out


def detect(path: str, warn=print) -> str:
    """dataset (a folder with meta/info.json), directory, mcap, hdf5, or unknown. A lone Parquet file raises."""
    if os.path.isdir(path):
        return "dataset" if os.path.isfile(os.path.join(path, "meta", "info.json")) else "directory"
    name = ENDINGS.get(os.path.splitext(path)[1].lower(), "unknown")
    if name == "parquet":
        raise IngestError(f"{path} is a single Parquet file; give the dataset's folder, the one with meta/info.json")
    if name == "hdf5" and os.path.isfile(path):
        with open(path, "rb") as f:
            if f.read(8) != HDF5_MAGIC:
                warn(f"{path} does not begin like an HDF5 file")
    return name


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, format, dataset_root) of all files below root; files of datasets belong to these and have their root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    roots = files.where(F.endswith("path", F.lit("/meta/info.json"))).select(F.regexp_replace("path", r"/meta/info\.json$", "").alias("dataset_root"))
    own = files.select("path", format_of(F.col("path")).alias("format"), F.explode(_parents(F.col("path"))).alias("dataset_root"))
    inside = own.join(roots, "dataset_root", "left_semi").groupBy("path").agg(F.min("dataset_root").alias("dataset_root"))
    return files.select("path", format_of(F.col("path")).alias("format")).join(inside, "path", "left").orderBy("path")


def _parents(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))

"""Scans of raw inputs: whole text files and ZIP archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of each file, read as a whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def chosen_entry(names: list[str]) -> str:
    """The first JSON entry whose name holds ``conversations``, else the first JSON entry."""
    found = [n for n in names if n.endswith(".json")]
    if not found:
        raise ValueError("No JSON file found in the archive")
    return next((n for n in found if "conversations" in n), found[0])


def unzip(data: bytes) -> tuple[str, str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        name = chosen_entry(z.namelist())
        return name, z.read(name).decode("utf-8")


def zip_files(binary: DataFrame) -> DataFrame:
    """path, entry, content of archives given as (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [unzip(bytes(c)) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "entry": [n for n, _ in found], "content": [t for _, t in found]})

    return binary.select("path", "content").mapInPandas(run, "path string, entry string, content string")


def archives(spark: SparkSession, path: str) -> DataFrame:
    return zip_files(spark.read.format("binaryFile").load(path))

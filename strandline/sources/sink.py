"""Sinks: notes as a table partitioned by folder, and as Markdown files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(notes: DataFrame, path: str) -> None:
    """The system of record: one Parquet table, a directory for each folder."""
    folder = F.regexp_replace(F.regexp_extract("path", "^(.*)/[^/]*\\z", 1), "/", "∕")
    notes.withColumn("folder", folder).write.mode("overwrite").partitionBy("folder").parquet(path)


def write_files(notes: DataFrame, root: str) -> DataFrame:
    """Writes each note below a folder that all executors mount; path and size of each.

    A file is written under a temporary name and renamed, so a task that runs again leaves no halves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = []
            for path, content in zip(b["path"], b["content"]):
                to = os.path.join(root, path.lstrip("/"))
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with open(f"{to}.part-{os.getpid()}", "w", encoding="utf-8") as f:
                    f.write(content)
                os.replace(f.name, to)
                sizes.append(len(content))
            yield pd.DataFrame({"path": b["path"], "size": sizes})

    return notes.select("path", "content").mapInPandas(run, "path string, size bigint")

"""Text sources and sinks: inline texts, files as bytes, log tables, JSON."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from glyphspark.functions.text import basename, suffix
from glyphspark.schema import PERFORMANCE_LOGS, SEARCH_HISTORY

# The file types that are searched and the largest file.
SUFFIXES = (".txt", ".log", ".csv", ".tsv", ".md", ".json", ".xml", ".html", ".py", ".js")
MAX_BYTES = 100 * 1024 * 1024


def inline(spark: SparkSession, *texts: str) -> DataFrame:
    """doc_id, text of literal texts."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def files(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """path, file_name, size_bytes, modified, content (bytes) of a file, folder or glob. check: other file types go, a file of over MAX_BYTES is an error
    (`file_chunks` reads files of any size)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if check:
        refused = F.raise_error(F.concat(F.lit("file too large: "), "path"))
        rows = rows.filter(accepted(F.col("path"))).withColumn("content", F.when(F.col("length") <= MAX_BYTES, F.col("content")).otherwise(refused))
    return rows.select("path", basename(F.col("path")).alias("file_name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")


def accepted(path):
    return suffix(path).isin(*SUFFIXES)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each line; large files are split over tasks."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


class FileChunks(DataSource):
    """Batch source `glyphspark_chunks`: files by offsets (options path, chunk_bytes, overlap). Each chunk is a partition of its own that opens the
    file and reads only its bytes, so a file's size bounds no task. Paths are local (shared by all executors) or URIs that pyarrow opens."""

    @classmethod
    def name(cls) -> str:
        return "glyphspark_chunks"

    def schema(self) -> str:
        return "path string, index int, start bigint, owned int, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _ChunkReader(self.options["path"], int(self.options["chunk_bytes"]), int(self.options["overlap"]))


@dataclass
class _Chunk(InputPartition):
    path: str
    index: int
    start: int
    owned: int


class _ChunkReader(DataSourceReader):
    def __init__(self, path: str, chunk_bytes: int, overlap: int):
        self.path, self.chunk_bytes, self.overlap = path, chunk_bytes, overlap

    def partitions(self) -> list[_Chunk]:
        system, place = _open(self.path)
        info = system.get_file_info(place)
        found = system.get_file_info(pafs.FileSelector(place, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        sizes = [(f.path, f.size) for f in found if f.type == pafs.FileType.File]
        step = self.chunk_bytes
        return [_Chunk(path, k, k * step, min(step, size - k * step)) for path, size in sizes for k in range(-(-size // step))]

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        system, _ = _open(self.path)
        with system.open_input_file(partition.path) as f:
            f.seek(partition.start)
            yield partition.path, partition.index, partition.start, partition.owned, f.read(partition.owned + self.overlap)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def file_chunks(spark: SparkSession, path: str, overlap: int, chunk_bytes: int) -> DataFrame:
    """path, index, start, owned, data of a file or of the files in a folder; each chunk owns `owned` bytes and reads `overlap` more."""
    spark.dataSource.register(FileChunks)
    return spark.read.format("glyphspark_chunks").option("path", path).option("chunk_bytes", chunk_bytes).option("overlap", overlap).load()


def log_row(spark: SparkSession, pattern: str, user_id: str, figures: dict, at) -> tuple[DataFrame, DataFrame]:
    """The search_history row and the performance_logs row of one search. A blank user is "anonymous".

    figures: algorithm, matches_count, duration_ms, text_size_bytes, path (of the first file, or None)."""
    user, path = user_id.strip() or "anonymous", figures["path"]
    history = (user, pattern, figures["algorithm"], [path] if path else [], figures["matches_count"], figures["duration_ms"], at)
    logs = (figures["algorithm"], path or "", figures["text_size_bytes"], figures["duration_ms"], figures["matches_count"], user, at)
    return spark.createDataFrame([history], SEARCH_HISTORY), spark.createDataFrame([logs], PERFORMANCE_LOGS)


def append(rows: DataFrame, path: str, best_effort: bool = False) -> bool:
    """Append rows to a Parquet table; best_effort logs a failure and reports False instead of raising it."""
    try:
        rows.write.mode("append").parquet(path)
    except Exception:
        if not best_effort:
            raise
        logging.getLogger(__name__).warning("could not append to %s", path, exc_info=True)
        return False
    return True


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)

"""Continuous searches that report only new matches.

State per watched file is the set of offsets seen last. A changed file is searched again as a whole; offsets that were not
there before are new; on truncation or rewriting the state becomes the new set. The first sight of a file fills the state without
a report. An unreadable file reports its error and leaves the state alone.

With append_only a change reads just the appended bytes, and the last pattern length less one before them, and the state is one number: how
many bytes were searched. A file that got shorter is a new one, and all its matches are new. Bytes that are overwritten in place, and a file that is
replaced by a longer one between two looks, go unnoticed; files that change like that need the whole search, which is the default.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphspark.functions.match import occurrences, to_bytes
from glyphspark.schema import MONITOR_EVENT


class FileTail(DataSource):
    """Streaming source `glyphspark_tail`: one row (path, start, content, error) whenever the file at option `path` has changed.

    Option overlap: content starts so many bytes before the last known end (start); without it, at 0."""

    @classmethod
    def name(cls) -> str:
        return "glyphspark_tail"

    def schema(self) -> str:
        return "path string, start bigint, content binary, error string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        overlap = self.options.get("overlap")
        return _TailReader(self.options["path"], None if overlap is None else int(overlap))


class _TailReader(SimpleDataSourceStreamReader):
    """The offset is the file's size and time of change, and a batch is the file up to that size, from 0 or from the size before less overlap."""

    def __init__(self, path: str, overlap: int | None = None):
        self.path, self.overlap = path, overlap

    def initialOffset(self) -> dict:
        return {"size": -1, "changed": -1}

    def _stamp(self) -> dict:
        try:
            stat = os.stat(self.path)
        except OSError:
            return {"size": -2, "changed": -2}
        return {"size": stat.st_size, "changed": stat.st_mtime_ns}

    def _rows(self, before: int, size: int) -> list[tuple]:
        """What the offsets `before` and `size` stand for, also when a batch is read again after the file has grown."""
        start = 0 if self.overlap is None or not 0 <= before <= size else max(0, before - self.overlap)
        try:
            with open(self.path, "rb") as f:
                f.seek(start)
                return [(self.path, start, f.read(size - start) if size >= 0 else f.read(), None)]
        except OSError as e:
            return [(self.path, 0, None, str(e))]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = self._stamp()
        return iter(self._rows(start["size"], now["size"]) if now != start else []), now

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start["size"], end["size"]))


def tail(spark: SparkSession, path: str, overlap: int | None = None) -> DataFrame:
    """A stream of a growing file's contents: path, start, content, error. overlap: only appended bytes and so many before them."""
    spark.dataSource.register(FileTail)
    reader = spark.readStream.format("glyphspark_tail").option("path", os.path.abspath(path))
    return (reader if overlap is None else reader.option("overlap", overlap)).load()


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the files that arrive in a folder: path, start, content, error. Files are immutable once there."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).load(folder)
    return rows.select("path", F.lit(0).cast("bigint").alias("start"), "content", F.lit(None).cast("string").alias("error"))


def events(stream: DataFrame, pattern: str | bytes, watch_id: str, algorithm: str = "KMP", report_first: bool = False, append_only: bool = False) -> DataFrame:
    """(path, start, content, error) -> monitor events: only changes with new matches or an error.

    append_only: content is what came after the bytes searched before (see `tail`); all_matches then are the new ones."""
    needle = to_bytes(pattern)
    shown = needle.decode("utf-8", "replace")

    def whole(content: bytes, start: int, before: list[int]) -> tuple[list[int], list[int], list[int]]:
        now, seen = occurrences(content, needle), set(before)
        return [p for p in now if p not in seen], now, now

    def appended(content: bytes, start: int, before: int) -> tuple[list[int], list[int], int]:
        end = start + len(content)
        searched = before if before <= end else 0  # a shorter file is a new one
        new = [start + p for p in occurrences(content, needle) if start + p + len(needle) > searched]
        return new, new, end

    search, kind, nothing = (appended, "bigint", 0) if append_only else (whole, "array<long>", [])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = []
        for frame in frames:
            for start, content, error in zip(frame["start"], frame["content"], frame["error"], strict=True):
                base = {"watch_id": watch_id, "file": key[0], "pattern": shown, "algorithm": algorithm, "timestamp": time.time()}
                if error is not None and not pd.isna(error):
                    rows.append(base | {"new_matches": [], "all_matches": [], "error": error})
                    continue
                first = not state.exists
                new, now, kept = search(bytes(content or b""), int(start), nothing if first else state.get[0])
                state.update((kept,))
                if new and (report_first or not first):
                    rows.append(base | {"new_matches": new, "all_matches": now, "error": ""})
        if rows:
            yield pd.DataFrame(rows)[["watch_id", "file", "pattern", "algorithm", "new_matches", "all_matches", "timestamp", "error"]]

    return stream.groupBy("path").applyInPandasWithState(step, MONITOR_EVENT, f"seen {kind}", "update", GroupStateTimeout.NoTimeout)


class Monitor:
    """Running watches by id."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.watches: dict[str, object] = {}

    def watch(self, path: str, pattern: str | bytes, callback: Callable[[dict], None], algorithm: str = "KMP", checkpoint: str | None = None, append_only: bool = False) -> str:
        """Call back with each event of a file; returns the watch's id. An error in the callback does not end the watch."""
        watch_id = str(uuid.uuid4())

        def report(batch: DataFrame, _epoch: int) -> None:
            for row in batch.toLocalIterator():
                try:
                    callback(row.asDict())
                except Exception as e:  # the user's function
                    print(f"watch {watch_id}: callback failed: {e}")

        overlap = max(0, len(to_bytes(pattern)) - 1) if append_only else None
        found = events(tail(self.spark, path, overlap), pattern, watch_id, algorithm, append_only=append_only)
        writer = found.writeStream.outputMode("update").foreachBatch(report).trigger(processingTime="500 milliseconds")
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        self.watches[watch_id] = writer.start()
        return watch_id

    def stop(self, watch_id: str) -> bool:
        query = self.watches.pop(watch_id, None)
        if query is not None:
            query.stop()
        return query is not None

    def stop_all(self) -> None:
        for watch_id in list(self.watches):
            self.stop(watch_id)

    def active_watches(self) -> list[str]:
        return [k for k, q in self.watches.items() if q.isActive]


def windowed_counts(rows: DataFrame, time_col: str, window: str, watermark: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Rows per event-time window and keys; works on streams (late rows beyond the watermark go) and on tables."""
    span = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    counted = rows.withWatermark(time_col, watermark).groupBy(span.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")

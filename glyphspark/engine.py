"""The engine's front: one object with all operators."""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from glyphspark import __version__
from glyphspark.functions import entities, match
from glyphspark.operators import analytics, recommend, search
from glyphspark.operators.search import COMPARE_BYTES, MAX_PATTERNS
from glyphspark.schema import ENTITY
from glyphspark.shipping import ship
from glyphspark.sources import files
from glyphspark.streaming.monitor import Monitor


class Engine:
    """Search and analytics on a Spark session. With log_path, searches are appended to history and performance tables there."""

    def __init__(self, spark: SparkSession | None = None, log_path: str | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        ship(self.spark)
        self.log_path = log_path
        self.monitor = Monitor(self.spark)

    @staticmethod
    def version() -> str:
        return f"glyphspark {__version__}"

    def texts(self, source: str | DataFrame) -> DataFrame:
        """A DataFrame as it is, or one row (doc_id, text) for a literal text. Files are read with `files`, never guessed."""
        return source if isinstance(source, DataFrame) else files.inline(self.spark, source)

    def files(self, path: str) -> DataFrame:
        return files.files(self.spark, path).withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))

    def search(self, source: str | DataFrame, pattern: str, algorithm: str = "AUTO", user_id: str = "", **options) -> DataFrame:
        """The search's results. With a log path the search runs once, here: its results are written below that path, and one row is
        appended to each log, with what it measured; without, it runs when the result is used."""
        texts = self.texts(source)
        found = search.search(texts, pattern, algorithm=algorithm, **options)
        return found if self.log_path is None else self._logged(found, pattern, user_id, options.get("text_col", "text"))

    def _logged(self, found: DataFrame, pattern: str, user_id: str, text_col: str) -> DataFrame:
        seen = Observation()
        path = F.min("path") if "path" in found.columns else F.lit(None).cast("string")
        size = F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).cast("bigint")
        watched = found.observe(seen, F.max(F.col("algorithm")).alias("algorithm"), F.coalesce(F.sum("match_count"), F.lit(0)).alias("matches_count"), size.alias("text_size_bytes"), F.max(path).alias("path") if "path" not in found.columns else path.alias("path"))
        results = f"{self.log_path}/results/{uuid.uuid4().hex}"
        began, at = time.perf_counter(), datetime.now(timezone.utc)
        watched.write.parquet(results)
        figures = dict(seen.get) | {"duration_ms": (time.perf_counter() - began) * 1000}
        figures["algorithm"] = figures["algorithm"] or ""
        history, logs = files.log_row(self.spark, pattern, user_id, figures, at)
        files.append(history, f"{self.log_path}/search_history", best_effort=True)
        files.append(logs, f"{self.log_path}/performance_logs", best_effort=True)
        return self.spark.read.schema(found.schema).parquet(results)

    def search_file(self, path: str, pattern: str, **options) -> DataFrame:
        """path, pos of the matches in files of any size."""
        return search.search_file(self.spark, path, pattern, **options)

    def search_multi(self, source: str | DataFrame, patterns: list[str], id_col: str = "doc_id", max_patterns: int | None = MAX_PATTERNS, **options) -> DataFrame:
        return search.search_multi(self.texts(source), patterns, id_col, max_patterns=max_patterns, **options)

    def compare(self, source: str | DataFrame, pattern: str, id_col: str = "doc_id", max_bytes: int | None = COMPARE_BYTES, **options) -> DataFrame:
        return search.compare(self.texts(source), pattern, id_col, max_bytes=max_bytes, **options)

    def extract_entities(self, source: str | DataFrame, text_col: str = "text") -> DataFrame:
        return self.texts(source).withColumn("entities", entities.extract_entities(F.col(text_col)))

    def history(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.log_path}/search_history")

    def performance_logs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.log_path}/performance_logs")

    def trending(self, days: int = 7, limit: int = 10, as_of=None) -> DataFrame:
        return analytics.trending(self.history(), F.current_timestamp() if as_of is None else as_of, days, limit)

    def recommend(self, user_id: str) -> DataFrame:
        return recommend.recommend_user(self.history(), self.performance_logs(), user_id)

    def start_monitoring(self, path: str, pattern: str, callback, algorithm: str = "KMP", append_only: bool = False) -> str:
        return self.monitor.watch(path, pattern, callback, algorithm, append_only=append_only)

    def stop_monitoring(self, watch_id: str | None = None) -> None:
        if watch_id is None:
            self.monitor.stop_all()
        else:
            self.monitor.stop(watch_id)

    def register_functions(self) -> None:
        """SQL functions find_all(text, pattern), fuzzy_find(text, pattern, k) and extract_entities(text), and the table functions
        matches_of(text, pattern) and entities_of(text)."""
        register(self.spark)


def register(spark: SparkSession) -> None:
    @F.arrow_udf("array<bigint>")
    def find_all(text: pa.Array, pattern: pa.Array) -> pa.Array:
        both = zip(text.cast(pa.binary()).to_pylist(), pattern.cast(pa.binary()).to_pylist(), strict=True)
        return pa.array([None if t is None or p is None else match.occurrences(t, p) for t, p in both], pa.list_(pa.int64()))

    @F.arrow_udf("array<bigint>")
    def fuzzy_find(text: pa.Array, pattern: pa.Array, k: pa.Array) -> pa.Array:
        rows = []
        for t, p, errors in zip(text.cast(pa.binary()).to_pylist(), pattern.cast(pa.binary()).to_pylist(), k.to_pylist(), strict=True):
            if t is None or p is None or errors is None:
                rows.append(None)
            elif not t or not p:
                rows.append([])
            else:
                rows.append((match.compat_ends if len(p) <= 64 else match.edit_ends)(t, p, max(0, errors)))
        return pa.array(rows, pa.list_(pa.int64()))

    kind = pa.list_(pa.struct([("type", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(f"array<{ENTITY}>")
    def extract(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else entities.entities_of(t) for t in text.to_pylist()], kind)

    @F.udtf(returnType="pos bigint")
    class MatchesOf:
        def eval(self, text: str, pattern: str):
            for p in match.occurrences((text or "").encode(), (pattern or "").encode()):
                yield (p,)

    @F.udtf(returnType="type string, value string, start int, end int")
    class EntitiesOf:
        def eval(self, text: str):
            for e in entities.entities_of(text or ""):
                yield e["type"], e["value"], e["start"], e["end"]

    spark.udtf.register("matches_of", MatchesOf)
    spark.udtf.register("entities_of", EntitiesOf)
    spark.udf.register("find_all", find_all)
    spark.udf.register("fuzzy_find", fuzzy_find)
    spark.udf.register("extract_entities", extract)

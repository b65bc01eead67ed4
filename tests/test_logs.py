from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from glyphspark.engine import Engine
from glyphspark.operators import analytics, recommend, store
from glyphspark.sources import files

NOW = datetime(2024, 2, 1)


def history(spark, rows):
    return spark.createDataFrame([(u, q, a, ["f"], m, d, t) for u, q, a, m, d, t in rows], "user_id string, query string, algorithm string, files array<string>, matches_count long, duration_ms double, run_at timestamp")


def logs(spark, rows):
    return spark.createDataFrame([(a, "", s, d, m, u, NOW) for u, a, s, d, m in rows], "algorithm string, file_path string, text_size_bytes long, duration_ms double, matches_count long, user_id string, created_at timestamp")


def test_totals_and_top(spark):
    h = history(spark, [("u", "Fox", "KMP", 2, 1.0, NOW), ("u", "fox", "KMP", 3, 2.0, NOW - timedelta(days=7)), ("u", "dog", "AUTO", 0, 3.0, NOW - timedelta(days=8)), ("v", "fox", "AUTO", 1, 4.0, NOW)])
    assert tuple(analytics.user_totals(h, "u").first()) == (3, 5, 2.0)
    assert tuple(analytics.user_totals(h, "w").first()) == (0, 0, 0.0)
    stats = analytics.user_stats(h, "u").first()
    assert stats["algorithms"] == {"KMP": 2, "AUTO": 1} and stats["most_used_algorithm"] == "KMP"
    assert analytics.user_stats(h, "w").first()["most_used_algorithm"] is None
    assert [tuple(r)[:2] for r in analytics.trending(h, F.lit(NOW), 7, 10).collect()] == [("fox", 2), ("Fox", 1)]
    assert [r[0] for r in analytics.autocomplete(h, "FO").collect()] == ["fox", "Fox"]
    assert analytics.autocomplete(h, " ").count() == 0
    assert [r["query"] for r in analytics.page(h, "run_at", "query", 1, 1, user_id="u").collect()] == ["fox"]
    with pytest.raises(ValueError):
        analytics.page(h, "run_at", "query", 0)
    assert analytics.clamp("trending", 500) == 50


def test_recommendations(spark):
    def run(rows, perf):
        return recommend.recommend_user(history(spark, [("u", "q", a, 1, ms, NOW) for a, ms in rows]), logs(spark, perf), "u").first()

    none = run([], [])
    assert (none["confidence"], none["recommended_algorithm"], none["rules"]) == ("none", "AUTO", ["R1"])
    auto = run([("AUTO", 1.0)] * 8 + [("KMP", 1.0)] * 2, [])
    assert "R2" in auto["rules"] and any("AUTO" in t for t in auto["tips"]) and auto["confidence"] == "medium"
    slow = run([("KMP", 10.0)] * 25, [("u", "KMP", 10, 10.0, 300)] * 15 + [("u", "Boyer-Moore", 2_000_000, 2.0, 1)] * 10)
    assert slow["recommended_algorithm"] == "Boyer-Moore" and slow["confidence"] == "high"
    assert slow["rules"] == ["R3", "R4", "R5", "R7"] and "5.0x" in slow["insights"][0]
    assert any("500 ms" in t for t in run([("KMP", 800.0)] * 3, [])["tips"])


def test_versions(spark):
    v = spark.createDataFrame([(1, "a", 1, False), (1, "b", 2, False), (2, "c", 1, False), (2, "d", 3, True)], "id int, name string, at int, gone boolean")
    assert [r["name"] for r in store.latest(v, "id", "at", "name", F.col("gone")).collect()] == ["b"]
    twice = store.unique_violations(v, "id", "name").collect()
    assert {(r["field"], r["value"]) for r in twice} == {("id", "1"), ("id", "2")}


def test_access(spark):
    users = spark.createDataFrame([("1", "admin", True), ("2", "user", True), ("3", "admin", False)], "id string, role string, is_active boolean")
    requests = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "user_id string")
    assert {r[0] for r in store.allowed(requests, users).collect()} == {"1", "2"}
    assert {r[0] for r in store.allowed(requests, users, role="admin").collect()} == {"1"}
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "admin_id int, target_id int")
    assert store.deletable(pairs).count() == 1


def test_files_and_engine(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "app.log").write_text("ok\nERROR one\nERROR two\n")
    (data / "more.txt").write_text("an ERROR")
    (data / "photo.exe").write_bytes(b"ERROR")
    engine = Engine(spark, log_path=str(tmp_path / "logs"))
    found = engine.search(engine.files(str(data)), "ERROR", user_id="u").orderBy("file_name").collect()
    assert [(r["file_name"], r["match_count"]) for r in found] == [("app.log", 2), ("more.txt", 1)]
    assert engine.search("the cat and the rat", "cat").first()["match_count"] == 1
    assert engine.search("nothing", "cat", cap=0).count() == 1
    logged = engine.history().orderBy("run_at").collect()
    assert [(r["user_id"], r["query"], r["matches_count"], r["algorithm"], len(r["files"])) for r in logged] == [("u", "ERROR", 3, "Shift-Or", 1), ("anonymous", "cat", 1, "KMP", 0), ("anonymous", "cat", 0, "KMP", 0)] or logged[0]["algorithm"] == "KMP"
    assert len(logged) == 3 and all(r["duration_ms"] > 0 for r in logged)
    logs = engine.performance_logs().orderBy("created_at").collect()
    assert [r["text_size_bytes"] for r in logs] == [31, 19, 7] and all(r["duration_ms"] > 0 for r in logs)
    assert engine.recommend("u").first()["confidence"] == "low"
    assert engine.trending(limit=1).count() == 1
    (tmp_path / "file").write_text("")
    assert not files.append(engine.history(), str(tmp_path / "file" / "table"), best_effort=True)
    assert engine.extract_entities("mail a@b.co").first()["entities"][0]["value"] == "a@b.co"
    engine.register_functions()
    assert spark.sql("select find_all('aaaa', 'aa') as x, fuzzy_find('catt', 'cat', 1) as y, extract_entities('a@b.co')[0].type as z").first().asDict() == {"x": [0, 1, 2], "y": [2, 3], "z": "EMAIL"}
    assert [r["pos"] for r in spark.sql("select pos from matches_of('aaaa', 'aa') order by pos").collect()] == [0, 1, 2]
    assert spark.sql("select e.type from values ('a@b.co') as t(x), lateral entities_of(x) e").first()["type"] == "EMAIL"
    with pytest.raises(ValueError):
        engine.search_multi("x", [str(k) for k in range(60)])


def test_files_of_any_size_are_read_by_offsets(spark, tmp_path, monkeypatch):
    places = [0, 999, 1_000_000, 1_999_997, 2_999_995]
    data = bytearray(b"x" * 3_000_000)
    for p in places:
        data[p : p + 5] = b"ERROR"
    (tmp_path / "big.log").write_bytes(bytes(data))
    (tmp_path / "empty.log").write_bytes(b"")
    engine = Engine(spark)
    for where in (str(tmp_path), f"file://{tmp_path}"):
        parts = files.file_chunks(spark, where, 4, 1_000_000)
        assert parts.rdd.getNumPartitions() == 3 and max(len(r["data"]) for r in parts.collect()) == 1_000_004
        assert sorted(r["pos"] for r in engine.search_file(where, "ERROR", chunk_bytes=1_000_000).collect()) == places
    monkeypatch.setattr(files, "MAX_BYTES", 1000)
    with pytest.raises(Exception, match="file too large"):
        files.files(spark, str(tmp_path)).collect()
    assert [r["file_name"] for r in files.files(spark, str(tmp_path), check=False).collect()] == ["big.log"]  # Spark passes over empty files

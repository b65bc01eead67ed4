import time

from pyspark.sql import functions as F

from glyphspark.streaming.monitor import Monitor, _TailReader, arriving, events, windowed_counts


def wait_for(condition, seconds=40):
    end = time.time() + seconds
    while time.time() < end and not condition():
        time.sleep(0.2)
    return condition()


def test_watch_reports_only_new_matches(spark, tmp_path):
    log, seen = tmp_path / "app.log", []
    log.write_text("ERROR at the start\n")
    monitor = Monitor(spark)
    watch = monitor.watch(str(log), "ERROR", seen.append, checkpoint=str(tmp_path / "state"))
    try:
        query = monitor.watches[watch]
        assert wait_for(lambda: query.lastProgress is not None and any(p["numInputRows"] for p in query.recentProgress))
        with log.open("a") as f:
            f.write("fine\nERROR again\n")
        assert wait_for(lambda: seen)
        assert seen[0]["new_matches"] == [24] and seen[0]["all_matches"] == [0, 24] and seen[0]["error"] == ""
        assert monitor.active_watches() == [watch]
    finally:
        assert monitor.stop(watch)
    assert not monitor.stop(watch)


def test_appended_bytes_alone_are_read(tmp_path):
    log = tmp_path / "app.log"
    log.write_bytes(b"0123456789")
    reader = _TailReader(str(log), overlap=4)
    rows, first = reader.read(reader.initialOffset())
    assert [r[1:3] for r in rows] == [(0, b"0123456789")]
    log.write_bytes(b"0123456789abc")
    rows, second = reader.read(first)
    assert [r[1:3] for r in rows] == [(6, b"6789abc")]
    log.write_bytes(b"0123456789abcdef")
    assert [r[1:3] for r in reader.readBetweenOffsets(first, second)] == [(6, b"6789abc")]
    log.write_bytes(b"new")
    rows, third = reader.read(second)
    assert [r[1:3] for r in rows] == [(0, b"new")]
    log.unlink()
    rows, gone = reader.read(third)
    assert [(r[2], bool(r[3])) for r in rows] == [(None, True)] and not list(reader.read(gone)[0])


def test_append_only_watch(spark, tmp_path):
    log, seen = tmp_path / "app.log", []
    log.write_text("ERROR at the start, ERR")
    monitor = Monitor(spark)
    watch = monitor.watch(str(log), "ERROR", seen.append, checkpoint=str(tmp_path / "state"), append_only=True)
    try:
        query = monitor.watches[watch]
        assert wait_for(lambda: any(p["numInputRows"] for p in query.recentProgress))
        with log.open("a") as f:
            f.write("OR and ERROR\n")  # the first of them stands across the old end
        assert wait_for(lambda: len(seen) == 1)
        log.write_text("ERROR\n")  # shorter: a new file
        assert wait_for(lambda: len(seen) == 2)
        log.unlink()
        assert wait_for(lambda: len(seen) == 3)
        assert [e["new_matches"] for e in seen] == [[20, 30], [0], []] and seen[2]["error"]
    finally:
        monitor.stop_all()


def test_arriving_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("ERROR ERROR")
    found = events(arriving(spark, str(folder)), "ERROR", "w", report_first=True)
    query = found.writeStream.outputMode("update").format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r["new_matches"] for r in spark.table("arrived").collect()] == [[0, 6]]


def test_windows_on_a_table(spark):
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as k union all select timestamp'2024-01-01 00:50:00', 'a' union all select timestamp'2024-01-01 01:10:00', 'b'")
    assert sorted((r["k"], r["n"]) for r in windowed_counts(rows, "ts", "1 hour", "5 minutes", "k").collect()) == [("a", 2), ("b", 1)]
    assert windowed_counts(rows, "ts", "1 hour", "5 minutes", "k", slide="30 minutes").agg(F.sum("n")).first()[0] == 6

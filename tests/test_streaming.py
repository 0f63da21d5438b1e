"""Several micro-batches and a replayed one leave each overpass and alert once."""

import datetime as dt

from tidemark.streaming import incremental as inc


def items(spark, path, ids):
    rows = [(i, dt.date(2024, 1, 1 + i % 5), i % 3, "S2A", 10) for i in ids]
    spark.createDataFrame(rows, "item_id long, d date, orbit int, platform string, cloud int").coalesce(1).write.mode("append").parquet(path)


def test_screening_over_batches(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    schema = "item_id long, d date, orbit int, platform string, cloud int"
    seen = []
    for ids in (range(0, 7), range(3, 12), range(0, 15)):
        items(spark, src, ids)
        stream = spark.readStream.schema(schema).parquet(src)
        inc.run_to_end(inc.screen_overpasses(stream, None, out, log, 30))
        seen.append(spark.read.parquet(out).count())
    tags = [r["tag"] for r in spark.read.parquet(out).select("tag").collect()]
    assert len(tags) == len(set(tags)) == 15 and seen == sorted(seen)


def test_alerts_once(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    schema = "incident_id long, status string, role string, priority string, seen_at timestamp"
    known = spark.createDataFrame([(1,)], "incident_id long")
    for batch in ([1, 2, 2, 3], [2, 3, 4]):
        rows = [(i, "DETECTED" if i != 3 else "RESOLVED", "operational", "high", dt.datetime(2024, 1, 1, i)) for i in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        inc.run_to_end(inc.raise_alerts(spark.readStream.schema(schema).parquet(src), known, out, log, "seen_at"))
    got = sorted((r["incident_id"], r["level"]) for r in spark.read.parquet(out).select("incident_id", "level").collect())
    assert got == [(2, "HIGH"), (4, "HIGH")]


def test_late_incident_still_alerts(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    schema = "incident_id long, status string, role string, priority string, seen_at timestamp"
    known = spark.createDataFrame([], "incident_id long")
    for i, day in ((1, dt.datetime(2024, 6, 1)), (2, dt.datetime(2024, 6, 2)), (3, dt.datetime(2024, 1, 1))):
        spark.createDataFrame([(i, "DETECTED", "operational", "low", day)], schema).coalesce(1).write.mode("append").parquet(src)
        inc.run_to_end(inc.raise_alerts(spark.readStream.schema(schema).parquet(src), known, out, log, "seen_at"))
    assert sorted(r["incident_id"] for r in spark.read.parquet(out).select("incident_id").collect()) == [1, 2, 3]


def test_many_batches_replay_and_repeats_without_reading_output(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    schema = "incident_id long, status string, role string, priority string, seen_at timestamp"
    known = spark.createDataFrame([(0,)], "incident_id long")
    for k in range(12):                                                # every file repeats half of the one before
        rows = [(i, "DETECTED", "operational", "high" if i % 2 else "low", dt.datetime(2024, 1, 1 + k)) for i in range(4 * k, 4 * k + 8)]
        rows.append((4 * k + 7, "DETECTED", "operational", "medium", dt.datetime(2023, 1, 1)))       # an earlier row of the same batch counts
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    run = inc.raise_alerts(stream, known, out, log, "seen_at")
    inc.run_to_end(run)
    progress = [p for p in run.recentProgress if p["numInputRows"]]
    assert len(progress) == 12 and all(p["numInputRows"] == 9 for p in progress)          # a batch reads its own rows only
    got = spark.read.parquet(out)
    levels = {r["incident_id"]: r["level"] for r in got.collect()}
    assert got.count() == len(levels) == 51 and 0 not in levels
    assert levels[7] == "MEDIUM" and levels[8] == "LOW"
    # the last batch again: its commit is taken back, the same rows come out
    import os
    last = max(int(n) for n in os.listdir(log + "/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{log}/commits/{name}"):
            os.remove(f"{log}/commits/{name}")
    inc.run_to_end(inc.raise_alerts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), known, out, log, "seen_at"))
    assert {r["incident_id"]: r["level"] for r in spark.read.parquet(out).collect()} == levels and spark.read.parquet(out).count() == 51


def test_tiles_of_one_overpass_in_several_batches(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    schema = "item_id long, d date, orbit int, platform string, cloud int"
    done = spark.createDataFrame([("none",)], "tag string")
    for k in range(4):
        rows = [(k, dt.date(2024, 1, 1), 5, "S2A", 10), (k, dt.date(2024, 1, 1), None, "S2A", 10), (k, dt.date(2024, 1, 2 + k), 5, "S2A", 90), (k, dt.date(2024, 1, 2 + k), 5, "S2B", 5)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    inc.run_to_end(inc.screen_overpasses(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), done, out, log, 30))
    tags = [r["tag"] for r in spark.read.parquet(out).collect()]
    assert len(tags) == len(set(tags)) == 6


def test_alerts_keep_native_state(spark, tmp_path):
    rows = "incident_id long, status string, role string, priority string, at timestamp"
    src = str(tmp_path / "in")
    spark.sql("SELECT 1L AS incident_id, 'DETECTED' AS status, 'operational' AS role, 'HIGH' AS priority, timestamp'2024-01-01' AS at").write.parquet(src)
    known = spark.createDataFrame([], "incident_id long")
    q = inc.raise_alerts(spark.readStream.schema(rows).parquet(src), known, str(tmp_path / "out"), str(tmp_path / "log"), "at")
    inc.run_to_end(q)
    kinds = {s["operatorName"] for p in q.recentProgress for s in p["stateOperators"]}
    assert kinds == {"stateStoreSave"} and [r.incident_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]

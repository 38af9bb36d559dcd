import datetime as dt

from tessera.streaming import events


def write(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, events.EVENTS).coalesce(1).write.mode(mode).parquet(path)


def row(k, minute, user=1, kind="click"):
    return (k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), user, kind, 1.0, "{}")


def test_windows_and_sessions(spark, tmp_path):
    path = f"{tmp_path}/events"
    write(spark, path, [row(k, k * 7, k % 2, "click" if k % 3 else "view") for k in range(40)])
    got = events.drained(events.windowed_votes(events.read_events(spark, path), "event_type", "1 hour"), "complete")
    batch = spark.read.parquet(path).groupBy("event_type").count().collect()
    assert {r.event_type: r["sum(votes)"] for r in got.groupBy("event_type").sum("votes").collect()} == {r.event_type: r["count"] for r in batch}
    slide = events.drained(events.windowed_votes(events.read_events(spark, path), "event_type", "1 hour", "30 minutes"), "complete")
    assert slide.agg({"votes": "sum"}).first()[0] == 80
    s = events.drained(events.sessions(events.read_events(spark, path), "user_id", "10 minutes"), "complete")
    assert s.count() == 40


def test_late_rows_are_left_out(spark, tmp_path):
    path = f"{tmp_path}/late"
    for batch in ([row(1, 0), row(2, 200)], [row(4, 400)], [row(3, 1), row(5, 401)], [row(6, 402)]):
        write(spark, path, batch)
    got = events.drained(events.windowed_votes(events.read_events(spark, path, files=1), "event_type", "10 minutes", late="5 minutes"), "append")
    assert sorted((r.start.minute + 60 * r.start.hour, r.votes) for r in got.collect())[:2] == [(0, 1), (200, 1)]


def test_once(spark, tmp_path):
    path = f"{tmp_path}/twice"
    write(spark, path, [row(1, 0), row(1, 1), row(2, 2)])
    assert events.drained(events.once(events.read_events(spark, path), ["event_id"]), "append").count() == 2


def test_leases(spark, tmp_path):
    schema = "task string, lease string, event string, at double, gpus double"
    for k, rows in enumerate([[("t", "a", "start", 1.0, 2.0), ("t", "b", "finish", 9.0, 0.0)], [("t", "a", "finish", 4.0, 0.0)], [("t", "b", "start", 5.0, 1.0), ("t", "c", "start", 0.0, 1.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    got = events.drained(events.leases(stream), "append")
    assert sorted((r.lease, r.seconds) for r in got.collect()) == [("a", 6.0), ("b", 4.0)]


def test_evidence_log(spark, tmp_path):
    log = events.EvidenceLog(spark, f"{tmp_path}/evidence")
    log.append(spark.createDataFrame([("u1", "detector", 1, "x"), ("u2", "detector", 2, "y"), ("u3", "human", 1, "z")], "uid string, role string, version long, payload string"))
    assert log.active("detector").count() == 2
    log.revoke(spark.createDataFrame([("u1", 3, "blurred")], "uid string, version long, reason string"))
    assert [r.uid for r in log.active("detector").collect()] == ["u2"]
    assert log.active("detector", 2).count() == 2

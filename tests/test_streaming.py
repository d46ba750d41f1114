from datetime import datetime, timedelta

from loamdex.streaming import watch

T0 = datetime(2024, 1, 1)
ROWS = [(1, "a", "x.py", 0), (2, "a", "x.py", 2), (3, "a", "y.py", 5), (4, "a", "z.py", 9), (5, "b", "x.py", 0), (6, "a", "build/q.py", 6), (7, "a", None, 7), (1, "a", "x.py", 0), (8, "a", "late.py", 4000)]
SCHEMA = "change_id bigint, service_id string, path string, change_kind string, event_ts timestamp_ntz, received_at timestamp_ntz"


def rows(spark):
    return spark.createDataFrame([(i, s, p, "modified", T0 + timedelta(seconds=t), T0 + timedelta(seconds=t + 1)) for i, s, p, t in ROWS], SCHEMA)


def test_batch(spark):
    got = watch.debounced(watch.relevant(watch.once(rows(spark))))
    assert sorted((r["service_id"], r["events"]) for r in got.collect()) == [("a", 1), ("a", 1), ("a", 3), ("b", 1)]


def test_stream_runs_services(spark, tmp_path):
    rows(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    ran, failed = [], []

    def run(service):
        ran.append(service)
        if service == "b":
            failed.append(service)
            raise RuntimeError

    q = watch.follow(watch.debounced(watch.relevant(watch.once(stream))), run, str(tmp_path / "cp"), every=None, initial=lambda: ran.append("baseline"))
    q.awaitTermination(120)
    assert ran[0] == "baseline" and "a" in ran and "b" in ran and failed == ["b"]

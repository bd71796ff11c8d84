from pyspark.sql import functions as F

from lodespark.sources import state
from lodespark.streaming import events
from tests.conftest import rows


def write_events(spark, folder):
    data = [(i, f"2024-01-01 0{i % 3}:{i % 60:02}:00", f"u{i % 4}", "click" if i % 2 else "view") for i in range(60)] + [(1, "2024-01-01 01:01:00", "u1", "click"), (99, "2024-01-03 00:00:00", "u9", "view")]
    df = spark.createDataFrame(data, "event_id long, t string, user_id string, event_type string").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type")
    df.coalesce(1).write.mode("overwrite").parquet(folder)
    return df


def test_streams_equal_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = write_events(spark, folder)
    stream = lambda: events.event_stream(spark, folder, df)
    once = events.drain(events.unique_within_watermark(stream(), ["event_id"]), "once", str(tmp_path / "c1"))
    assert once.count() == df.select("event_id").distinct().count()
    hours = rows(events.drain(events.tumbling_counts(stream(), "ts", "event_type"), "hours", str(tmp_path / "c2")))
    want = rows(df.where("ts < '2024-01-02'").groupBy(F.date_trunc("hour", "ts").alias("w"), "event_type").count())
    assert hours == want
    seen = rows(events.drain(events.tracked(stream(), "user_id", "event_type"), "seen", str(tmp_path / "c3"), "update"))
    assert ("u1", 1, "click", "click", "open") in seen and len(seen) == 5
    assert events.drain(events.topic(stream(), "event_type", "view"), "views", str(tmp_path / "c4")).count() == df.where("event_type = 'view'").count()


def test_state_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, None, None)], "k int, v string, l array<int>")
    assert rows(state.import_json(state.export_json(df), df.schema)) == rows(df)
    path = str(tmp_path / "state.json")
    assert state.load_json_state(spark, path, df.schema).count() == 0
    (tmp_path / "state.json").write_text("{broken")
    assert state.load_json_state(spark, path, df.schema).count() == 0
    (tmp_path / "state.json").write_text('[{"k": 1, "v": "x"}]')
    assert rows(state.load_json_state(spark, path, df.schema)) == [(1, "x", None)]
    out = str(tmp_path / "out")
    state.save_state(df, out)
    state.save_state(df.limit(1), out)
    assert spark.read.parquet(out).count() == 1


def test_text_files(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    for name, text in (("a.py", "x = 1"), ("b.PY", "é"), ("c.bin", "no"), ("node_modules/d.py", "no"), ("big.md", "x" * 300)):
        (tmp_path / "src" / name).write_text(text)
    got = {r.path.rsplit("/", 1)[1]: r.size for r in state.fingerprints(spark, str(tmp_path / "src"), max_bytes=100).collect()}
    assert got == {"a.py": 5, "b.PY": 2}


def test_traceback_and_coverage(spark):
    t = 'Traceback (most recent call last):\n  File "a.py", line 3, in f\n  File "b.py", line 7, in g\nValueError: x'
    df = spark.createDataFrame([(t,), ("fine",), (None,)], "t string")
    got = [tuple(r[0]) for r in df.select(state.traceback_place(F.col("t"))).collect()]
    assert got == [("b.py", 7, "ValueError"), (None, None, None), (None, None, None)]
    c = spark.createDataFrame([('{"files": {"a": {"summary": {"percent_covered": 50.0}}, "b": {"summary": {"percent_covered": 90}}}}',), ("x",)], "j string")
    assert rows(state.low_coverage(c, "j")) == [("a", 50.0)]

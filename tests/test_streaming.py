import os

from drawlake.streaming import ingest


def test_progress_and_running_bill(spark, tmp_path):
    schema = spark.createDataFrame([], "file_id string, name string, qty double, at timestamp").schema
    for k in range(3):
        spark.sql(f"SELECT * FROM VALUES ('f{k}', 'a', 2.0D, timestamp '2024-01-01 00:0{k}:00'), ('f{k}', 'b', 1.0D, timestamp '2024-01-01 00:30:00'), (null, 'a', 1.0D, timestamp '2024-01-01 02:00:00') AS t(file_id, name, qty, at)").coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        # one file a write, with times apart: the source takes files by time
        (file,) = (tmp_path / f"w{k}").glob("*.parquet")
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.utime(file, (1_700_000_000 + 60 * k,) * 2)
        os.rename(file, tmp_path / "in" / f"{k}.parquet")

    def items():
        return ingest.stream_table(spark, str(tmp_path / "in"), schema, files_per_trigger=1)

    ingest.progress_sink(items(), "count", str(tmp_path / "out"), str(tmp_path / "cp1")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("file_id").sum("n_items", "n_errors").collect()
    assert sorted(tuple(r) for r in got) == [("", 3, 3), ("f0", 2, 0), ("f1", 2, 0), ("f2", 2, 0)]
    ingest.stream_bill(items(), ["name"], "qty", str(tmp_path / "cp2"), str(tmp_path / "bill")).awaitTermination()
    assert sorted(tuple(r) for r in ingest.latest_bill(spark, str(tmp_path / "bill"), ["name"]).collect()) == [("a", 6, 9.0), ("b", 3, 3.0)]
    ingest.compact_bill(spark, str(tmp_path / "bill"), ["name"])
    assert sorted(p.name for p in (tmp_path / "bill").glob("version=*")) == ["version=2"] and not (tmp_path / "bill" / "_folded").exists()
    assert sorted(tuple(r) for r in ingest.latest_bill(spark, str(tmp_path / "bill"), ["name"]).collect()) == [("a", 6, 9.0), ("b", 3, 3.0)]
    w = ingest.windowed_quantities(items(), "at", ["name"], "qty").writeStream.outputMode("append").format("memory").queryName("win_test").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    w.awaitTermination()
    # the first file's last row moves the watermark past the first hour; it holds for late rows one batch on, so the third file's early rows come too late
    assert {(r["name"], r["n_rows"]) for r in spark.table("win_test").collect() if r["start"].hour == 0} == {("a", 2), ("b", 2)}
    first = ingest.stream_dedup(items(), ["name"]).select("name").writeStream.format("memory").queryName("first_test").option("checkpointLocation", str(tmp_path / "cp4")).trigger(availableNow=True).start()
    first.awaitTermination()
    assert sorted(r["name"] for r in spark.table("first_test").collect()) == ["a", "b"]
    within = ingest.stream_dedup(items(), ["name"], "at").select("name").writeStream.format("memory").queryName("within_test").option("checkpointLocation", str(tmp_path / "cp5")).trigger(availableNow=True).start()
    within.awaitTermination()
    assert sorted(r["name"] for r in spark.table("within_test").collect()) == ["a", "b"]


def test_a_key_that_was_away_is_new_again():
    """The processor's state machine, with time in its hands."""
    import pandas as pd

    class Value:
        now = None

        def exists(self):
            return self.now is not None

        def get(self):
            return self.now

        def update(self, v):
            self.now = v

        def clear(self):
            self.now = None

    class Handle:
        def __init__(self):
            self.timers, self.value = set(), Value()

        def getValueState(self, name, schema):
            return self.value

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.discard(at)

    class Clock:
        def __init__(self, at):
            self.at = at

        def getCurrentProcessingTimeInMs(self):
            return self.at

    handle, p = Handle(), ingest.FirstArrival(100)
    p.init(handle)
    rows = lambda: iter([pd.DataFrame({"k": ["x", "x"], "n": [1, 2]})])
    assert [d["n"].tolist() for d in p.handleInputRows(("x",), rows(), Clock(0))] == [[1]] and handle.timers == {100}
    assert list(p.handleInputRows(("x",), rows(), Clock(60))) == [] and handle.timers == {160}
    assert list(p.handleExpiredTimer(("x",), Clock(160), None)) == [] and not handle.value.exists()
    assert len(list(p.handleInputRows(("x",), rows(), Clock(300)))) == 1

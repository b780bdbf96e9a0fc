from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from faultlines.streaming import streams as ST

DELAY = timedelta(days=1)


def _day(text: str) -> datetime:
    return datetime.fromisoformat(text)


# arriving batches: times out of order, ties, a null time, rows of closed windows, a batch of late rows alone
BATCHES = [
    [("2024-01-01 10:00:00", "a", 1.0), ("2024-01-02 09:00:00", "a", 2.0), (None, "a", 5.0)],
    [("2024-01-05 08:00:00", "b", 3.0), ("2024-01-01 23:00:00", "a", 4.0)],
    [("2024-01-01 10:00:00", "a", 7.0), ("2024-01-03 10:00:00", "b", 8.0), ("2024-01-03 10:00:00", "b", 8.0)],
    [("2024-01-05 08:00:00", "b", None), ("2024-01-04 00:00:00", None, 2.0), ("2024-01-09 00:00:00", "a", 1.0)],
]


def _expected():
    mark, on_time, late = None, Counter(), Counter()
    for batch in BATCHES:
        for at, kind, _ in batch:
            start = at and _day(at).replace(hour=0, minute=0, second=0)
            gone = start is not None and mark is not None and start + timedelta(days=1) <= mark
            (late if gone else on_time)[(start, kind)] += 1
        times = [_day(at) - DELAY for at, _, _ in batch if at]
        mark = max([*times, mark] if mark else times)
    closed = lambda start: start is not None and start + timedelta(days=1) <= mark
    return {key: (closed(key[0]), on_time[key], late[key]) for key in on_time | late}


def _run(spark, base):
    ST.window_stream(ST.read_stream(spark, f"{base}/in", 1000), f"{base}/out", f"{base}/cp", "1 day").awaitTermination()


def _rows(spark, base):
    return {(r["window_start"], r["event_type"]): (r["closed"], r["on_time"], r["late"]) for r in ST.window_table(spark, f"{base}/out", "1 day").collect()}


def test_late_rows_are_kept_apart(spark, tmp_path):
    base = str(tmp_path)
    for batch in BATCHES:
        rows = spark.createDataFrame(batch, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
        rows.write.mode("append").parquet(f"{base}/in")
        _run(spark, base)
    expected = _expected()
    assert _rows(spark, base) == expected and sum(n for _, _, n in expected.values()) == 3
    late = ST.deltas(spark, f"{base}/out/late")
    assert sorted(r["value"] for r in late.collect()) == [7.0, 8.0, 8.0]

    _run(spark, base)  # nothing new arrives
    assert _rows(spark, base) == expected


def test_a_replayed_epoch_changes_nothing(spark, tmp_path):
    """The checkpoint loses its last commit, as after a crash between the writes and the commit."""
    base = str(tmp_path)
    for batch in BATCHES[:3]:
        rows = spark.createDataFrame(batch, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
        rows.write.mode("append").parquet(f"{base}/in")
        _run(spark, base)
    before = _rows(spark, base)
    commits = tmp_path / "cp" / "commits"
    for name in ("2", ".2.crc"):
        (commits / name).unlink(missing_ok=True)
    _run(spark, base)
    assert _rows(spark, base) == before

"""Appends to the table of events."""

from pathlib import Path

from vigil.sources.readers import write_events

DAY = 86_400_000_000


def test_appends_add_up_and_a_day_has_few_files(spark, tmp_path):
    rows = spark.range(0, 400, numPartitions=16).selectExpr("id AS event_id", f"(id % 3) * {DAY} AS t")
    write_events(rows, str(tmp_path / "events"), "t")
    days = sorted(p.name for p in Path(tmp_path / "events").glob("day=*"))
    assert days == ["day=1970-01-01", "day=1970-01-02", "day=1970-01-03"]
    assert all(len(list(Path(tmp_path / "events" / d).glob("*.parquet"))) == 1 for d in days)
    write_events(rows.limit(0), str(tmp_path / "events"), "t")
    write_events(rows.where("event_id = 4"), str(tmp_path / "events"), "t")
    stored = spark.read.parquet(str(tmp_path / "events"))
    assert stored.count() == 401 and stored.where("event_id = 4").count() == 2
    assert stored.where("day <> date_format(timestamp_micros(t), 'yyyy-MM-dd')").isEmpty()

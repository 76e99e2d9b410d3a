"""Streaming ingest: the row contract, late events, and files that are read once."""

import datetime as dt

from pyspark.sql import functions as F

from tidecast.sources import readers
from tidecast.streaming import ingest


def test_checked_results(spark, tmp_path):
    rows = [("1", "2020-01-01", " A ", "B", "1", "0", "yes"), ("1", "2020-01-01", "A", "B", "1", "0", "yes"), ("2", "2020-01-02", "A", "A", "1", "0", "no"), ("3", "2020-01-03", "A", "C", "x", "0", "no")]
    names = ["match_id", "kickoff_utc", "team1", "team2", "team1_goals", "team2_goals", "neutral"]
    source = str(tmp_path / "in")
    df = spark.createDataFrame(rows, names)
    df.write.parquet(source)
    stream = ingest.checked_results(ingest.stream_table(spark, source, df.schema, files_per_trigger=1))
    assert stream.isStreaming
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    ingest.run_to_parquet(stream, out, offsets)
    got = sorted((r.match_id, r.team1, r.valid) for r in spark.read.parquet(out).collect())
    assert got == [("1", "A", True), ("2", "A", False), ("3", "A", False)]
    # a second run reads only what is new
    spark.createDataFrame([("4", "2020-01-04", "A", "D", "0", "0", "no")], names).write.mode("append").parquet(source)
    ingest.run_to_parquet(ingest.checked_results(ingest.stream_table(spark, source, df.schema)), out, offsets)
    assert spark.read.parquet(out).count() == 4


def test_late_events_are_left_out(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    source = str(tmp_path / "events")
    schema = "ts timestamp, event_type string, value double"
    for i, part in enumerate([[(at(0), "a", 1.0), (at(0, 30), "a", 2.0)], [(at(9), "a", 5.0)], [(at(0, 5), "a", 100.0), (at(8, 30), "b", 3.0)], [(at(20), "a", 0.0)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{source}/p={i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{source}/*")
    out = str(tmp_path / "out")
    ingest.run_to_parquet(ingest.windowed_counts(stream), out, str(tmp_path / "offsets"))
    got = {(r.start.hour, r.event_type): r.total for r in spark.read.parquet(out).collect()}
    assert got[(0, "a")] in (3.0, 103.0) and got[(8, "b")] == 3.0  # order of files within a trigger is theirs


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("m", "2020-01-01 12:00:00", "A", "B", 1, 0, "Friendly", True)], "match_id string, kickoff_utc string, team1 string, team2 string, team1_goals int, team2_goals int, tournament string, neutral boolean")
    readers.write_csv(df.select("neutral", *df.columns[:-1]), str(tmp_path / "csv"))
    matches, violations = readers.read_matches(spark, str(tmp_path / "csv"))
    assert violations.isEmpty() and matches.first().team1_goals == 1
    files = readers.file_checksums(spark, str(tmp_path / "csv"), "*.csv")
    expected = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.upper("sha256").alias("sha256"))
    assert readers.verify_checksums(files, expected).isEmpty()
    assert readers.verify_checksums(files, expected.withColumn("sha256", F.lit("00"))).count() == files.count()
    gone = spark.createDataFrame([("none.csv", "00")], "name string, sha256 string")
    assert readers.verify_checksums(files, gone).count() == 1


def test_reconcile(spark):
    schema = "match_id string, kickoff_utc timestamp, team1 string"
    t = dt.datetime(2020, 1, 1)
    one = spark.createDataFrame([("1", t, "A"), ("2", t, None), ("3", t, "C")], schema)
    two = spark.createDataFrame([("1", t, "B"), ("2", t, None), ("4", t, "C")], schema)
    got = sorted((r.match_id, r.field, r.status) for r in readers.reconcile(one, two, ["kickoff_utc", "team1"]).collect())
    assert got == [("1", "team1", "mismatch"), ("3", "match_id", "left_only"), ("4", "match_id", "right_only")]

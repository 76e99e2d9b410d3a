"""Files beyond the size of a row, reconciliation by ranges, and a corpus that grows."""

import gzip
import hashlib
import json
import os

from pyspark.sql import functions as F

from tidecast.sources import readers


def test_checksums_of_files_of_any_size(spark, tmp_path):
    """A sparse file of over 2 GB, empty and odd names: the library's digests, block by block."""
    with open(tmp_path / "large file.bin", "wb") as f:
        f.truncate((2 << 30) + 12_345)
        f.seek(1 << 30)
        f.write(b"middle")
    for name, data in (("empty.bin", b""), ("ünï%20.bin", b"abc")):
        (tmp_path / name).write_bytes(data)
    got = {os.path.basename(r.path): (r.length, r.sha256) for r in readers.file_checksums(spark, str(tmp_path), "*.bin").collect()}
    assert set(got) == {"large file.bin", "ünï%20.bin"} and got["large file.bin"][0] == (2 << 30) + 12_345
    want = set()
    for p in (x for x in tmp_path.glob("*.bin") if x.stat().st_size):
        with open(p, "rb") as f:
            want.add((p.stat().st_size, hashlib.file_digest(f, "sha256").hexdigest()))
    assert set(got.values()) == want
    assert readers.file_checksums(spark, str(tmp_path), "*.none").collect() == []


def tables(spark, n):
    left = spark.range(n).select(F.concat(F.lit("m"), "id").alias("match_id"), F.when(F.col("id") % 7 != 0, (F.col("id") * 3 % 101).cast("string")).alias("a"), (F.col("id") % 5).alias("b"))
    right = left.where("match_id not in ('m5', 'm77')").withColumn("a", F.when(F.col("match_id") == "m14", F.lit("")).when(F.col("match_id") == "m900", F.lit(None)).otherwise(F.col("a")))
    return left, right.unionByName(spark.createDataFrame([("new", "x", 1)], "match_id string, a string, b long"))


def test_ranges_give_the_whole_report(spark):
    left, right = tables(spark, 200_000)
    want = sorted(map(tuple, readers.reconcile(left, right, ["a", "b"]).collect()), key=str)
    got = sorted(map(tuple, readers.reconcile_ranges(left, right, ["a", "b"], leaf_rows=50).collect()), key=str)
    assert got == want and len(want) == 5
    ranges, depth = readers.differing_ranges(left, right, ["a", "b"], leaf_rows=50)
    inside = left.join(F.broadcast(ranges), F.shiftrightunsigned(F.xxhash64("match_id"), 64 - depth) == F.col("prefix"), "left_semi").count()
    assert ranges.count() == 5 and inside < 500  # of 200,000


def test_equal_and_unlike_tables(spark):
    left, _ = tables(spark, 3000)
    assert readers.reconcile_ranges(left, left, ["a", "b"]).collect() == []
    other = left.withColumn("b", F.lit(-1).cast("long"))
    got = readers.reconcile_ranges(left, other, ["a", "b"], most=100)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, readers.reconcile(left, other, ["a", "b"]).collect()), key=str)
    empty = left.limit(0)
    assert readers.reconcile_ranges(left, empty, ["a"], leaf_rows=10_000).count() == 3000 and readers.reconcile_ranges(empty, empty, ["a"]).collect() == []


def snapshot(folder, schedule, teams):
    results = [{"TeamName": [{"Locale": "en-GB", "Description": t}], "Rank": i + 1, "TotalPoints": 100 - i} for i, t in enumerate(teams)]
    with gzip.open(folder / f"{schedule}.json.gz", "wt") as f:
        json.dump({"Results": results}, f)


def test_corpus_grows_by_new_snapshots(spark, tmp_path):
    files, corpus = tmp_path / "files", str(tmp_path / "corpus")
    files.mkdir()
    schedules = spark.createDataFrame([(f"id{i}", f"2020-0{i}-01") for i in range(1, 6)], "schedule_id string, d string").select("schedule_id", F.to_timestamp("d").alias("published_at"))
    snapshot(files, "id1", ["A", "B"])
    snapshot(files, "id2", ["B", "A", "C"])
    assert readers.extend_ranking_corpus(spark, str(files), corpus, schedules) == 2
    assert readers.extend_ranking_corpus(spark, str(files), corpus, schedules) == 0  # nothing is read again
    snapshot(files, "id3", ["C"])
    # a run that broke off before the manifest leaves a batch that does not count, and is done again in its place
    first = readers.corpus_manifest(spark, corpus).count()
    assert readers.extend_ranking_corpus(spark, str(files), corpus, schedules) == 1 and first == 2
    spark.read.parquet(f"{corpus}/rows").limit(1).drop("batch").write.parquet(f"{corpus}/rows/batch=broken")
    got = sorted((r.schedule_id, r.team, r.fifa_rank) for r in readers.read_extended_corpus(spark, corpus).collect())
    assert got == [("id1", "A", 1), ("id1", "B", 2), ("id2", "A", 2), ("id2", "B", 1), ("id2", "C", 3), ("id3", "C", 1)]
    whole = readers.read_extended_corpus(spark, corpus).where("schedule_id = 'id2'").agg(F.max("rank_percentile")).first()[0]
    assert whole == 1.0

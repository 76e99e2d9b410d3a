"""Rounding without decimal objects: the values of ``round``, at a small part of its time."""

import random
import time

from pyspark.sql import functions as F

from tidecast.plans.registry import rounded


def test_values_are_those_of_round(spark):
    rng = random.Random(2)
    numbers = [0.0, -0.0, 0.5, -0.5, 2.5e-6, -2.5e-6, 0.0078125, -0.0078125, 1e-300, -1e-9, 123456789.987654321, 999999999.9999996, 1e9, 1e15 + 0.3, -1e300, float("nan"), float("inf"), float("-inf"), None]
    numbers += [rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 12) for _ in range(2_000)] + [rng.randrange(-400, 400) / rng.choice([2, 3, 7, 8, 100]) for _ in range(2_000)]
    df = spark.createDataFrame([(i, x, str(i)) for i, x in enumerate(numbers)], "i long, x double, s string")
    for digits in (6, 4):
        got = rounded(df, digits).select("i", "s", F.col("x").alias("got")).join(df.select("i", (F.round("x", digits) + F.lit(0.0)).alias("want")), "i")
        assert got.count() == len(numbers)
        assert got.where("not (got <=> want)").count() == 0
        assert got.where("s <> string(i)").count() == 0


def test_values_round_in_a_part_of_the_time(spark):
    df = spark.range(0, 1_000_000, 1, 2).select(*((F.col("id") * (0.3717 + i)).alias(f"c{i}") for i in range(6)))

    def took(out):
        times = []
        for _ in range(4):
            began = time.time()
            out.write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        return min(times)

    assert took(rounded(df)) < took(df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) for c in df.columns))) / 1.5

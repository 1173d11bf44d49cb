"""Percentiles over ranges against the one-buffer function."""

import random

from pyspark.sql import functions as F

from lontar.operators import summary


def test_percentiles(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2]), rnd.choice([None, rnd.random() * 100, float(rnd.randrange(4))])) for _ in range(3000)]
    rows += [("one", 1, 5.0), ("two", 1, 1.0), ("two", 1, 2.0), ("same", 1, 7.0), ("same", 1, 7.0), ("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(5)
    points = (0.0, 0.1, 0.5, 0.95, 0.99, 1.0)
    want = {(r["g"], r["h"]): r["p"] for r in df.where("v IS NOT NULL").groupBy("g", "h").agg(F.percentile("v", F.array(*map(F.lit, points))).alias("p")).collect()}
    got = {(r["g"], r["h"]): r["points"] for r in summary.percentiles(df, "v", ["g", "h"], points).collect()}
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k], strict=True))
    spread = summary.percentiles(df.withColumn("k", F.lit(1)), "v", ["k"], (0.5,)).first()["points"][0]
    assert abs(spread - df.agg(F.percentile("v", 0.5)).first()[0]) < 1e-9
    assert summary.percentiles(df.limit(0), "v", ["g"]).count() == 0
    whole = summary.number_summary(df, "v", []).first()
    assert whole["count"] == sum(r[2] is not None for r in rows) and whole["p50"] == round(spread, 2)
    assert {(r["g"], r["count"]) for r in summary.number_summary(df, "v", ["g"]).collect()} >= {("one", 1), ("two", 2), ("same", 2)}

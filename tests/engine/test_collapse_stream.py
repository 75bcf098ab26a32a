"""The stream of collapse points: out of order and in parts it ends where the batch form does."""

import random

from pyspark.sql import functions as F

from tremolo.operators import aggregates
from tremolo.sources import results
from tremolo.streaming import collapse

SCHEMA = "run_id long, ts timestamp, category string, level string, sim double"


def test_out_of_order_stream_ends_at_the_batch_form(spark, tmp_path):
    rng, source = random.Random(4), str(tmp_path / "in")
    falls = {"a": 3, "b": 9, "c": 1, None: 2}
    rows = []
    for i in range(1200):
        category, level = rng.choice(list(falls)), rng.randint(0, 5)
        good = level < falls[category] if rng.random() < 0.9 else level >= falls[category]
        rows.append((i, f"2024-01-01 {i % 20:02d}:{i % 60:02d}:00", category, f"L{level}", None if rng.random() < 0.02 else 0.9 if good else 0.1))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run_id long, ts string, category string, level string, sim double").withColumn("ts", F.to_timestamp("ts"))
    table = {r.category: r for r in aggregates.level_accuracy(df, "category").collect()}
    for part in range(3):  # each part holds rows of all hours
        df.where(F.col("run_id") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    events = collapse.collapse_points(stream, table["a"].L0, late="2 days")
    path = str(tmp_path / "out")
    put = results.sink(path, 2)
    q = events.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, n: put(b.select(F.col("category").alias("run"), F.lit(0).cast("long").alias("source_row"), "cp", "n", "closed"), n)).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    last = {r.run: r.cp for r in results.read(spark, path).collect()}
    assert last == {c: r.cp for c, r in table.items()} and last["c"] == "L1" and last["b"] is None


def test_collapse_of():
    assert collapse.collapse_of([9, 8, 1, 0, 0], [10, 10, 10, 0, 0], 0.8) == "L3"
    assert collapse.collapse_of([0] * 5, [0] * 5, 0.8) is None
    assert collapse.collapse_of([79995, 0, 0, 0, 0], [100000, 0, 0, 0, 0], 0.8) is None  # 0.79995 is 0.8 to four places


def test_a_silent_group_is_closed_and_late_rows_are_dropped(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    put = results.sink(path, 2)

    def arrive(*rows):
        df = spark.createDataFrame([(i, t, c, "L1", s) for i, t, c, s in rows], "run_id long, ts string, category string, level string, sim double").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        events = collapse.collapse_points(stream, 1.0, late="1 hour", idle_ms=3_600_000)
        q = events.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, n: put(b.select(F.col("category").alias("run"), F.lit(0).cast("long").alias("source_row"), "cp", "n", "closed"), n)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return {r.run: (r.cp, r.n, r.closed) for r in results.read(spark, path).collect()}

    assert arrive((1, "2024-01-01 00:00:00", "a", 0.1)) == {"a": ("L1", 1, False)}
    got = arrive((2, "2024-01-01 12:00:00", "b", 0.9))
    assert got["a"] == ("L1", 1, True) and got["b"] == (None, 1, False)
    arrive((3, "2024-01-01 01:00:00", "b", 0.1))
    got = arrive((4, "2024-01-01 12:30:00", "c", 0.9))
    assert got["b"] == (None, 1, False) and got["c"] == (None, 1, False)

"""Outcomes of forecasts from shuffled, late batches against the batch form."""

import random

import pytest

from barloom.streaming import pending

ROWS = "symbol string, tf string, t long, id long, horizon long, c double"


@pytest.fixture
def stream(spark, tmp_path):
    pending.use_rocks(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run(batches, late, expire):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, ROWS).coalesce(1).write.json(f"{tmp_path}/in/{k:03d}")
        read = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(f"{tmp_path}/in/*")
        out = pending.outcomes(read, late, expire)
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        progress = [p for p in query.recentProgress if p.stateOperators]
        return sorted(map(tuple, spark.read.schema(pending.OUTCOMES).parquet(f"{tmp_path}/out").collect())), progress

    yield run
    spark.conf.unset(pending.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def tape(seed, n=40):
    rnd, rows = random.Random(seed), []
    for symbol in ("A", "B"):
        for k in range(n):
            t, close = 10**6 + k * 600, round(100 + rnd.gauss(0, 3), 2)
            rows.append((symbol, "m10", t, None, None, close))
            if k % 3 == 0:
                rows.append((symbol, "m10", t, k, rnd.choice([1, 2, 5]), close))
    return rows


def test_shuffled_batches_give_the_rows_of_a_batch(spark, stream):
    rows = tape(1)
    rnd = random.Random(2)
    jittered = sorted(rows, key=lambda r: r[2] + rnd.uniform(0, 1500))  # out of order by up to 25 minutes
    batches = [jittered[k : k + 18] for k in range(0, len(jittered), 18)] + [[("Z", "m10", 10**7, None, None, 1.0)]]
    df = spark.createDataFrame(rows, ROWS)
    want = sorted(map(tuple, pending.of_batch(df.where("id is null"), df.where("id is not null")).collect()))
    got, _ = stream(batches, "30 minutes", 10**8)
    assert [r[:6] for r in got] == [r[:6] for r in want] and [round(r[6], 6) for r in got] == [round(r[6], 6) for r in want]
    assert len(want) > 20


def test_dead_series_are_forgotten(stream):
    first = [("dead", "m10", 10**6, None, None, 1.0), ("dead", "m10", 10**6, 7, 5, 1.0)]
    live = [[("live", "m10", 10**6 + 600 * k, None, None, 1.0)] for k in range(1, 60, 6)]
    got, progress = stream([first, *live], "10 minutes", 3600)
    assert got == []
    keys = [sum(o.numRowsTotal for o in p.stateOperators) for p in progress]
    assert keys[-1] <= max(keys) and keys[-1] < 12  # the dead series' bar, forecast and times are gone

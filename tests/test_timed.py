"""Typed state with lifetimes and timers against the batch forms."""

import time

from factloom.operators import stats
from factloom.streaming import timed


def _until(spark, query, table, enough, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if query.exception():
            raise query.exception()
        rows = spark.table(table).collect()
        if enough(rows):
            return rows
        time.sleep(0.5)
    raise AssertionError(spark.table(table).collect())


def test_routes_are_forgotten_by_the_clock(spark, tmp_path):
    schema = "key string, seq long, strategy string, score double, minimum double"
    put = lambda k, *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    put(0, ("k", 1, "direct", 0.9, 0.5), ("k", 2, "direct", 0.1, 0.5), ("k", 3, "direct", 0.1, 0.5), ("k", 4, "direct", 0.1, 0.5), ("j", 5, "direct", 0.4, 0.5))
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    out = timed.remembered_routes(stream, ["cached", "reduced"], "restart", lifetime=6.0)
    q = out.writeStream.format("memory").queryName("timed_routes").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        first = _until(spark, q, "timed_routes", lambda rows: len(rows) >= 5)
        assert {(r.key, r.seq, r.strategy, r.depth) for r in first} == {("k", 1, "direct", 0), ("k", 2, "cached", 1), ("k", 3, "reduced", 2), ("k", 4, "restart", 2), ("j", 5, "cached", 1)}
        time.sleep(7)
        put(1, ("k", 6, "direct", 0.1, 0.5))
        again = _until(spark, q, "timed_routes", lambda rows: len(rows) >= 6)
        assert [(r.strategy, r.depth) for r in again if r.seq == 6] == [("cached", 1)]
    finally:
        q.stop()


def test_watched_series_equal_the_batch_form_and_fall_silent(spark, tmp_path):
    schema = "series string, seq long, score double"
    scores = [("a", k, 1.0 if k > 4 else float(k)) for k in range(30)] + [("b", k, float(k % 3)) for k in range(10)]
    for n in range(2):
        spark.createDataFrame([r for r in scores if r[1] // 15 == n], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = timed.watched_series(stream, silence=4.0).writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        rows = _until(spark, q, "watched", lambda rows: sum(r.event == "silent" for r in rows) >= 2 and len(rows) >= 42)
    finally:
        q.stop()
    want = {(r.series, r.seq): (round(r.velocity, 9), round(r.acceleration, 9), r.stall) for r in stats.kinetics(spark.createDataFrame(scores, schema), "series", ["seq"], "score").collect()}
    assert {(r.series, r.seq): (round(r.velocity, 9), round(r.acceleration, 9), r.stall) for r in rows if r.event != "silent"} == want
    assert [r.series for r in rows if r.event == "alarm"] == ["a"] and {r.series for r in rows if r.event == "silent"} == {"a", "b"}

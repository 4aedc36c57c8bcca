from pyspark.sql import functions as F

from factloom.operators import ledger, stats
from factloom.streaming import kinetics
from factloom.streaming import ledger as streams


def _feed(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_stream_equals_batch_kinetics(spark, tmp_path):
    schema = "series string, seq long, score double"
    scores = [("a", k, 1.0 if k > 4 else float(k)) for k in range(30)] + [("b", k, float(k % 3)) for k in range(10)]
    batches = [[r for r in scores if r[1] // 8 == k] for k in range(4)]
    stream = _feed(spark, str(tmp_path / "in"), batches, schema)
    q = kinetics.kinetics_stream(stream).writeStream.format("memory").queryName("kin").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.series, r.seq): (round(r.velocity, 9), round(r.acceleration, 9), r.stall) for r in spark.table("kin").collect()}
    batch = stats.kinetics(spark.createDataFrame(scores, schema), "series", ["seq"], "score")
    want = {(r.series, r.seq): (round(r.velocity, 9), round(r.acceleration, 9), r.stall) for r in batch.collect()}
    assert got == want
    assert spark.table("kin").where("alarm").count() == 1


def test_ledger_stream_continues_chains(spark, tmp_path):
    schema = "chain string, seq long, payload string"
    batches = [[("a", 0, "x"), ("b", 0, "y")], [("a", 1, "z")], [("a", 2, "w"), ("b", 1, "v")]]
    stream = _feed(spark, str(tmp_path / "in"), batches, schema)
    out = str(tmp_path / "ledger")
    q = stream.writeStream.foreachBatch(streams.ledger_writer(out)).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(out)
    assert got.count() == 5 and ledger.chain_faults(got, "chain").count() == 0
    whole = ledger.chained(spark.createDataFrame([r for b in batches for r in b], schema), "chain", "seq", "payload")
    assert got.select("chain", "block_hash").exceptAll(whole.select("chain", "block_hash")).count() == 0
    # A batch that comes again changes nothing.
    streams.ledger_writer(out)(spark.createDataFrame(batches[2], schema), 2)
    assert spark.read.parquet(out).count() == 5


def test_weights_and_cache(spark, tmp_path):
    visits = spark.createDataFrame([("s",), ("s",), ("t",)], "signature string")
    write = streams.weight_writer(str(tmp_path / "w"))
    write(visits, 0)
    write(visits.where("signature = 's'"), 1)
    assert {r.signature: r.weight for r in streams.weights(spark, str(tmp_path / "w")).collect()} == {"s": 4, "t": 1}
    edges = spark.createDataFrame([("base", "child")], "src string, dst string")
    cache = streams.cache_writer(str(tmp_path / "c"), edges)
    schema = "key string, fingerprint string"
    cache(spark.createDataFrame([("base", "1"), ("child", "1"), ("other", "1")], schema), 0)
    cache(spark.createDataFrame([("base", "2")], schema), 1)
    assert {(r.key, r.fingerprint) for r in spark.read.parquet(str(tmp_path / "c" / "1")).collect()} == {("base", "2"), ("other", "1")}
    assert spark.read.parquet(str(tmp_path / "c" / "0")).where(F.col("key") == "child").count() == 1

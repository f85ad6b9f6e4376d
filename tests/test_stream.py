import json

from palisade.streaming import audit


def test_hours(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    rows = [{"timestamp": f"2024-01-01T0{h}:10:00Z", "reason": "", "branch": "main", "tree_hash": ""} for h in (1, 1, 2, 5)]
    (logs / "a.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    q = audit.hourly(audit.read_log(spark, str(logs))).writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("hours").collect()) == [1, 1, 2]


def test_one_shot_tokens_as_in_the_batch(spark, tmp_path):
    """Events in three triggers: the stream uses up the tokens that the batch form does."""
    import datetime
    import random

    from palisade.operators import engine
    from palisade.streaming import bypass

    random.seed(3)
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    rows = [(random.choice(["main", "dev"]), at(h), h if random.random() < 0.6 else None) for h in range(60)]
    schema = "branch string, at timestamp, change_id long"
    for n in range(3):
        spark.createDataFrame(rows[20 * n : 20 * n + 20], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
        query = bypass.bypassed(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination(200)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    changes = spark.createDataFrame([(b, t, c) for b, t, c in rows if c is not None], "branch string, committed_at timestamp, change_id long")
    tokens = spark.createDataFrame([(b, t) for b, t, c in rows if c is None], "branch string, ts timestamp")
    assert got == sorted((r["branch"], r["change_id"]) for r in engine.bypassed(changes, tokens, "enforce").collect()) and got

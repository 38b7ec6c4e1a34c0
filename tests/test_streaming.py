"""Streams as steps: batches, replay, redelivery; native keyed state."""

from zedweave import Builder
from zedweave.streaming.driver import StreamDriver
from zedweave.streaming.native import STATE_PROVIDER, keyed_reduce, running_weights


def graph(spark):
    build = Builder(spark)
    own, r = build.create_input("k STRING, v BIGINT")
    out = r.group_min("k").get_arrangement(build)
    return own, out, build.begin("delta")


def test_batches_replay_and_redelivery(spark, tmp_path):
    src, log = str(tmp_path / "src"), "file://" + str(tmp_path / "log")
    schema = "k STRING, v BIGINT, _w BIGINT"
    own, out, run = graph(spark)
    driver, seen = StreamDriver(run, log), []

    def feed(rows, driver, own, mark):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        driver.start(stream, own, "kv", str(tmp_path / mark), lambda s, n: seen.append(n)).awaitTermination()

    feed([("a", 3, 1), ("a", 1, 1), ("b", 5, 1)], driver, own, "cp")
    assert out.to_dict(run) == {("a", 1): 1, ("b", 5): 1}
    feed([("a", 1, -1)], driver, own, "cp")
    assert out.to_dict(run) == {("a", 3): 1, ("b", 5): 1} and seen == [0, 1]
    own2, out2, run2 = graph(spark)
    again = StreamDriver(run2, log)
    assert again.recover(own2, "kv") == 2 and out2.to_dict(run2) == {("a", 3): 1, ("b", 5): 1}
    feed([("b", 2, 1)], again, own2, "cp")
    assert out2.to_dict(run2) == {("a", 3): 1, ("b", 2): 1}


def test_native_state(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "k STRING, v BIGINT, _w BIGINT"
    spark.createDataFrame([("a", 3, 1), ("a", 1, 1), ("b", 5, 1), ("b", 5, -1)], schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    spark.conf.set(*STATE_PROVIDER)
    try:
        for name, df in (("weights", running_weights(stream, ["k"])), ("least", keyed_reduce(stream, ["k"], lambda key, g: [(min(x for x, _ in g), 1)], "v BIGINT"))):
            got = []
            df.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).foreachBatch(lambda d, n: got.extend(map(tuple, d.collect()))).start().awaitTermination()
            assert sorted(got) == ([("a", 2), ("b", 0)] if name == "weights" else [("a", 1, 1)])
    finally:
        spark.conf.unset(STATE_PROVIDER[0])

import pytest
from pyspark.sql import functions as F

from tapeloom.plans.market import Market
from tapeloom.sources.tape import tape
from tapeloom.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tape") / "records")
    rows = tape(spark, SF).withColumn("ts", F.timestamp_micros((F.col("event_time_ns") / 1000).cast("long")))
    rows.orderBy("source_ordinal").coalesce(1).write.parquet(path)
    return path


def stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def test_batches_equal_those_of_the_table(spark, stored, tmp_path):
    got = streams.run_available(streams.stream_batches(stream(spark, stored)), f"{tmp_path}/out", f"{tmp_path}/cp").filter("not truncated")
    want = Market(spark, SF).batches.filter("quality_flags not like '%TRUNCATED%'").select("session_id", "batch_id", "n_records", "first_ordinal", "last_ordinal", "proxy_time_ns", "capture_time_ns")
    assert want.exceptAll(got.drop("truncated")).count() == 0 == got.drop("truncated").exceptAll(want).count()


def test_flow_equals_that_of_the_table(spark, stored, tmp_path):
    got = streams.run_available(streams.stream_flow(stream(spark, stored)), f"{tmp_path}/out", f"{tmp_path}/cp")
    want = streams.stream_flow(spark.read.parquet(stored))
    assert got.count() > 0 and got.exceptAll(want).count() == 0


def test_dedup(spark, stored, tmp_path):
    twice = stream(spark, stored).unionByName(stream(spark, stored))
    got = streams.run_available(streams.stream_dedup(twice, ["source_ordinal"]), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert got.count() == spark.read.parquet(stored).count() == got.select("source_ordinal").distinct().count()

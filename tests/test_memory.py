"""What one task holds must not grow with the table, nor be worked out twice."""

from tapeloom.operators import flow
from tapeloom.sources import tape

SF = "/root/testdata/sf0.001"


def test_lines_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tape, "PART_LINES", 100)
    rows = tape.task_results(spark, SF)
    lines = tape.load(spark, SF, "lineitem").count()
    assert rows.rdd.getNumPartitions() == -(-lines // 100)


def test_trailing_sums_work_out_their_rows_once(spark, tmp_path):
    spark.createDataFrame([("x", k, 3 * k, *[k] * 6) for k in range(20)], ["session_id", "batch_id", "obs_ns", *flow.FLOWS]).write.parquet(f"{tmp_path}/flows")
    found = flow.trailing_flow(spark.read.parquet(f"{tmp_path}/flows"), 9)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 1
    assert sorted((r.batch_id, r.trade_count) for r in found.collect()) == [(k, sum(j for j in range(20) if k - 3 < j <= k)) for k in range(20)]

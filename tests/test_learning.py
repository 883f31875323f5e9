"""The model queries' rows, at the size whose tape has many sessions."""

from pyspark.sql import functions as F

from tapeloom.plans import learning
from tapeloom.sources.tables import written


def test_every_development_session_but_the_first_is_scored(spark, monkeypatch):
    days = [f"2024-01-{d:02}" for d in range(1, 11)]  # six for development
    frame = spark.createDataFrame([(s, i, float(i % 5), 1.0 + i % 2, float(d), float(i % 3), 2.0, (i + d) % 3 - 1) for d, s in enumerate(days) for i in range(12)],
                                  ["session_id", "batch_id", *learning.FEATURES, "label"])
    monkeypatch.setattr(learning, "_samples", lambda s, d: written(frame))
    got = learning.oof_signal(spark, "").groupBy("session_id").agg(F.count("signal").alias("n")).collect()
    assert {r.session_id: r.n for r in got} == {s: 12 for s in days[1:6]}

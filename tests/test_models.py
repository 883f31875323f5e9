import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import models as M

NAMES = ["a", "b"]


def data(spark, classes):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2)) * [2, 5] + [1, -3]
    y = rng.choice(classes, 300, p=np.ones(len(classes)) / len(classes))
    x[:, 0] += 0.8 * y
    return spark.createDataFrame([(float(p), float(q), int(v), float(p - 2 * q + v), f"s{k % 4}") for k, ((p, q), v) in enumerate(zip(x, y))], "a double, b double, y int, cost double, session_id string"), x, y


@pytest.mark.parametrize("classes", [(-1, 0, 1), (-1, 1), (0,)])
def test_price_model_is_at_its_optimum(spark, classes):
    df, x, y = data(spark, classes)
    m = M.fit_price(df, NAMES, "y", c=0.5)
    down, same, up = m.probabilities()
    p = np.array([tuple(r) for r in df.select(down, same, up).collect()])
    assert np.allclose(p.sum(1), 1) and all((p[:, k] == 0).all() for k, c in enumerate(M.CLASSES) if c not in classes)
    if len(classes) == 1:
        return
    z = (x - x.mean(0)) / x.std(0)
    own = [M.CLASSES.index(c) for c in classes]
    for k, c in zip(own, classes):
        residual = p[:, k] - (y == c)
        w = np.array(m.coef[own.index(k)])
        if len(classes) == 2:
            if k == own[0]:
                continue
        assert abs(residual.sum()) < 1e-3
        assert np.abs(residual @ z + w / 0.5).max() < 2e-2
    assert M.PriceModel.loads(m.dumps()) == m


def test_ridge_has_its_closed_form(spark):
    df, x, _ = data(spark, (-1, 0, 1))
    scaler = M.fit_scaler(df, NAMES)
    coef, bias = M.fit_ridge(df, scaler, "cost", 7.0)
    z, t = (x - x.mean(0)) / x.std(0), np.array([r.cost for r in df.collect()])
    want = np.linalg.solve(z.T @ z + 7 * np.eye(2), z.T @ (t - t.mean()))
    assert np.allclose(coef, want) and bias == pytest.approx(t.mean())
    assert M.fit_ridge(df.withColumn("cost", F.lit(2.0)), scaler, "cost", 7.0) == ([0.0, 0.0], 2.0)


def test_action_model_and_support(spark):
    df, _, _ = data(spark, (0, 1))
    m = M.fit_action(df, NAMES, "y", "cost")
    assert 0 < df.agg(F.min(m.miss())).first()[0] < df.agg(F.max(m.miss())).first()[0] < 1
    assert M.fit_action(df.filter("y = 1"), NAMES, "y", "cost").miss_rate == 1.0
    rows = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (float("nan"), 1.0), (None, 1.0), (0.5, 9.0)], "a double, b double")
    assert [r[0] for r in rows.select(M.supported(NAMES, [0, 0], [1, 2], 10, 5)).collect()] == [True, True, False, False, False]
    with pytest.raises(ValueError, match="frozen"):
        M.check_schema(df, ["b", "a"])


def test_sessions_are_scored_by_those_before(spark):
    df, _, _ = data(spark, (-1, 0, 1))
    got = M.forward_chained(df, ["s0", "s1", "s2", "s3"], NAMES, "y", 2)
    assert {r[0] for r in got.select("session_id").distinct().collect()} == {"s2", "s3"}
    changed = df.withColumn("y", F.when(F.col("session_id") == "s3", -F.col("y")).otherwise(F.col("y")))
    again = M.forward_chained(changed, ["s0", "s1", "s2", "s3"], NAMES, "y", 2)
    key = lambda d: sorted((r.session_id, r.a, r.signal) for r in d.collect())
    assert key(got) == key(again)


def test_fits_over_counts_are_those_over_rows(spark, monkeypatch):
    """A table of rows that repeat is counted once, and each fit reads as many rows as are distinct; before, each read
    them all."""
    df, _, _ = data(spark, (-1, 0, 1))
    coarse = df.select("session_id", F.round(F.col("a") / 4).alias("a"), F.lit(0.1).alias("b"), "y")
    many = coarse.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(40))))
    scaler, plain = M.fit_weighted_scaler(M.counted(many, NAMES, "y"), NAMES), M.fit_scaler(many, NAMES)
    assert np.allclose(scaler.mean, plain.mean) and np.allclose(scaler.std, plain.std) and scaler.std[1] == 0.0
    read, real = [], M._assembled
    monkeypatch.setattr(M, "_assembled", lambda *a: read.append(a[0].count()) or real(*a))
    few, all_ = M.fit_price(coarse, NAMES, "y", c=40.0), M.fit_price(many, NAMES, "y", c=1.0)
    assert np.allclose(few.coef, all_.coef, atol=1e-4) and np.allclose(few.bias, all_.bias, atol=1e-4)
    assert M.log_loss(M.counted(many, NAMES, "y"), all_, "y") == pytest.approx(M.log_loss(M.counted(coarse, NAMES, "y"), all_, "y"))
    M.forward_chained(many, ["s0", "s1", "s2", "s3"], NAMES, "y", 2)
    M.select_price(many, many, NAMES, "y", (0.1, 1.0))
    assert len(read) == 6 and max(read) <= coarse.distinct().count() < many.count() / 40

import pytest

from tapeloom import __main__ as cli
from tapeloom import invariants, study
from tapeloom.operators import book
from tapeloom.plans.market import Market

SF = "/root/testdata/sf0.001"
SMALL = (("primary_pair", "primary_pair", True), ("risk_choice", "risk_choice", True), ("arrival_grid", "arrival_grid", False))


def test_study_is_frozen_and_reported(spark, tmp_path):
    out = str(tmp_path / "study")
    hashes = study.run_study(spark, SF, out, SMALL)
    assert set(hashes) == {f"{n}.parquet" for n, _, _ in SMALL} and study.require_complete(out) == hashes
    assert cli.main(["report", out]) == 0
    text = (tmp_path / "study" / "report.md").read_text()
    assert "## primary_pair" in text and study.UNDEFINED in text
    with pytest.raises(FileExistsError):
        study.run_study(spark, SF, out, SMALL)
    part = next((tmp_path / "study" / "risk_choice.parquet").glob("part-*"))
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(ValueError, match="frozen"):
        study.write_report(out)


def test_failed_study_has_no_report(spark, tmp_path):
    out = str(tmp_path / "bad")
    with pytest.raises(KeyError):
        study.run_study(spark, SF, out, (("x", "no such query", True),))
    with pytest.raises(ValueError, match="complete"):
        study.write_report(out)


def test_invariants(spark):
    m = Market(spark, SF)
    assert invariants.broken_levels(m.depth()).count() == 0
    assert {r.what for r in invariants.tallies(m.batches, m.states.filter("anomaly is not null")).collect()} == {"batch", "flag", "anomaly"}


def test_command_line(capsys):
    with pytest.raises(SystemExit) as e:
        cli.main(["nonsense"])
    assert e.value.code == 2


def test_settings_split_and_log_are_sealed(spark, tmp_path):
    split = {"dev": ["a", "b"], "test": ["c"]}
    made = lambda n, **k: study.run_study(spark, SF, str(tmp_path / n), (("risk_choice", "risk_choice", True),), **k) and tmp_path / n
    folder = made("one", split=split)
    study.log_access(str(folder), "test", "opened once more")  # may be added to
    study.write_report(str(folder))
    log = (folder / study.LOG).read_text()
    assert [line.split('"what": ')[1].split('"')[1] for line in log.splitlines()] == ["study", "risk_choice", "test", "report"]
    for changed in (log.replace("started", "stopped"), log[:10], ""):
        (folder / study.LOG).write_text(changed)
        with pytest.raises(ValueError, match="access log"):
            study.require_complete(str(folder))
    (folder / study.LOG).write_text(log)
    (folder / "split.json").write_text("{}")
    with pytest.raises(ValueError, match="split"):
        study.require_complete(str(folder))
    with pytest.raises(ValueError, match="several parts"):
        made("two", split={"dev": ["a"], "test": ["a"]})


def test_tasks_and_a_trace(spark, tmp_path, capsys, monkeypatch):
    assert cli.main(["tasks", SF, str(tmp_path / "tasks")]) == 0
    tasks = spark.read.parquet(str(tmp_path / "tasks")).filter("eligible")
    assert tasks.count()
    day, k, _ = tasks.orderBy("task_id").first().task_id.split(":")
    capsys.readouterr()
    assert cli.main(["trace", SF, f"{day}:{int(k)}:B"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert any(" sends PASSIVE_LIMIT" in x for x in lines) and any(" decides ARRIVAL" in x for x in lines) and any(" hears " in x for x in lines)

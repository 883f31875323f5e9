import os
from types import SimpleNamespace

import pytest

from tapeloom.llm import common


def session(setting, master):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: setting), sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_the_shared_folder():
    assert common.shared_dir(session("hdfs://n/checkpoints/", "spark://m:7077")) == "hdfs://n/checkpoints/tables-app-1"
    own = common.shared_dir(session(None, "local[2]"))
    assert own == common.shared_dir(session(None, "local[2]")) and own.startswith("file:///")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(session(None, "spark://m:7077"))


def test_written_tables_can_be_cleared(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}/tables")
    assert common.cut(spark.range(5), "five").count() == 5
    assert os.listdir(tmp_path / "tables")
    common.clear(spark)
    assert not (tmp_path / "tables").exists()

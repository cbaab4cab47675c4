"""Which folder written tables go to."""

from types import SimpleNamespace as Of

import pytest

from corvia.sources import written as store


def session(master: str, named: str | None = None, given: str | None = None):
    checkpoint = Of(isDefined=lambda: given is not None, get=lambda: given)
    kept: dict = {}
    conf = Of(get=lambda k, d: kept.get(k, d), set=kept.__setitem__)
    context = Of(master=master, getConf=lambda: {"spark.checkpoint.dir": named}, _jsc=Of(sc=lambda: Of(getCheckpointDir=lambda: checkpoint)))
    return Of(sparkContext=context, conf=conf)


def test_named_folder_comes_first():
    assert store.shared_dir(session("yarn", "hdfs://a/b/", "hdfs://c")) == "hdfs://a/b"
    assert store.shared_dir(session("k8s://x", None, "hdfs://c/d")) == "hdfs://c/d"


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[3,2,1024]"])
def test_no_folder_is_an_error_on_a_cluster(master):
    with pytest.raises(RuntimeError):
        store.shared_dir(session(master))


def test_one_folder_for_a_process_on_one_machine(monkeypatch, tmp_path):
    monkeypatch.setattr(store.tempfile, "mkdtemp", lambda prefix: str(tmp_path / prefix))
    one = session("local[4]")
    assert store.shared_dir(one) == store.shared_dir(one) == str(tmp_path / "corvia-")

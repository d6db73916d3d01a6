"""The shared folder: named by the cluster, made only for a local master."""

import pytest

from partcast.session import ensure_checkpoint_dir


class _Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)

    def set(self, key, value):
        self[key] = value


class _Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, path):
        self.folder = path


class _Session:
    def __init__(self, master, conf=None):
        self.conf, self.sparkContext = _Conf(conf or {}), _Context(master)


def test_a_cluster_must_name_it():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(_Session(master))


def test_the_named_folder_is_used():
    s = _Session("yarn", {"spark.checkpoint.dir": "hdfs:///shared"})
    assert ensure_checkpoint_dir(s) == "hdfs:///shared" and s.sparkContext.folder == "hdfs:///shared"


def test_a_local_master_gets_its_own(tmp_path, monkeypatch):
    monkeypatch.setenv("TMPDIR", str(tmp_path))
    assert ensure_checkpoint_dir(_Session("local[4]")).startswith(str(tmp_path))

"""The shared folder is taken from the session, and only a local one may go without."""

from types import SimpleNamespace

import pytest

from dataquay.session import checkpoint_root, scratch_dir


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, conf=None, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: (conf or {}).get(key, default)),
        sparkContext=Context(master, folder),
    )


def test_the_configured_folder_counts():
    spark = session("yarn", {"spark.checkpoint.dir": "hdfs://nn/shared"})
    assert checkpoint_root(spark) == "hdfs://nn/shared"
    assert spark.sparkContext.folder == "hdfs://nn/shared"
    assert scratch_dir(spark, "x").startswith("hdfs://nn/shared/dataquay/x-")
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_a_folder_set_on_the_context_is_kept():
    assert checkpoint_root(session("yarn", folder="hdfs://nn/own")) == "hdfs://nn/own"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(session("yarn"))


def test_a_local_session_gets_one_of_its_own():
    spark = session("local[4]")
    assert checkpoint_root(spark) == checkpoint_root(spark) == spark.sparkContext.folder

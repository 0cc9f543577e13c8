from types import SimpleNamespace

import pytest

from tracelode.sources.tables import shared_dir


class Context:
    """What ``shared_dir`` uses of a context."""

    def __init__(self, master, place=None):
        self.master, self.place = master, place

    def getCheckpointDir(self):
        return self.place

    def setCheckpointDir(self, place):
        self.place = place


def session(master, named=None, place=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: named or other), sparkContext=Context(master, place))


def test_the_named_folder_is_used():
    spark = session("spark://host:7077", named="hdfs://shared/", place="hdfs://other")
    assert shared_dir(spark) == "hdfs://shared"


def test_the_context_may_have_one():
    assert shared_dir(session("spark://host:7077", place="hdfs://other")) == "hdfs://other"


def test_a_cluster_must_name_one():
    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077"))


def test_one_machine_gets_one():
    spark = session("local[2]")
    first = shared_dir(spark)
    assert first.startswith("file://") and shared_dir(spark) == first

import os

import pytest

from tracequarry import session


class _Cluster:
    """A session on a cluster that has no checkpoint folder, as far as shared_dir() asks."""

    def __init__(self, spark, master):
        self.conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        empty = type("E", (), {"isEmpty": staticmethod(lambda: True)})
        self.sparkContext = type("S", (), {"master": master, "getConf": staticmethod(lambda: conf), "_jsc": type("J", (), {"sc": staticmethod(lambda: type("X", (), {"getCheckpointDir": staticmethod(lambda: empty)}))})})


def test_no_machine_local_folder_on_a_cluster(spark):
    with pytest.raises(RuntimeError):
        session.shared_dir(_Cluster(spark, "spark://somewhere:7077"))


def test_written_tables_can_be_swept(spark):
    df = session.written(spark.range(5), "five")
    path = df.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path) and df.count() == 5
    folder = os.path.dirname(os.path.dirname(path))
    other = session.scratch(spark, "x")
    assert os.path.dirname(other).endswith(os.path.basename(folder))
    session.remove(spark, os.path.dirname(path))
    assert not os.path.exists(path)

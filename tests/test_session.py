import os

import pytest

from tallyloom import session


class Conf:
    def __init__(self, **values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class Cluster:
    def __init__(self, **values):
        self.conf = Conf(**values)


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster(**{"spark.master": "spark://a:7077"}))
    assert session.shared_dir(Cluster(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///shared/"})) == "hdfs:///shared"
    assert session.shared_dir(Cluster(**{"spark.master": "local[4]"})).startswith("file:///")


def test_staged_tables_go_with_their_block(spark):
    with session.staging():
        kept = session.staged(spark.range(10), "test")
        path = kept.inputFiles()[0].removeprefix("file://")
        assert kept.count() == 10 and os.path.exists(path)
    assert not os.path.exists(path)

"""Session and shared folder: nothing is taken from the cluster."""

import pytest

from leadflow import session as S


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Stub:
    """As much of a session as the shared folder needs."""

    def __init__(self, **conf):
        self.conf = Conf({k.replace("__", "."): v for k, v in conf.items()})
        self.sparkContext = None


def test_missing_folder_raises_off_local_mode():
    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            S.checkpoint_dir(Stub(spark__master=master))


def test_folder_is_read_from_the_session():
    assert S.checkpoint_dir(Stub(spark__master="yarn", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"


def test_session_sets_no_size_of_its_own(monkeypatch):
    asked = {}

    class Builder:
        def appName(self, name):
            return self

        def master(self, m):
            asked["master"] = m
            return self

        def config(self, k, v):
            asked[k] = v
            return self

        def getOrCreate(self):
            return type("s", (), {"sparkContext": type("c", (), {"setLogLevel": lambda self, x: None})()})()

    monkeypatch.setattr(S.SparkSession, "builder", Builder())
    S.build_session()
    assert not {"master", "spark.driver.memory", "spark.sql.shuffle.partitions"} & set(asked)
    S.build_session(master="local[2]", shuffle_partitions=4)
    assert asked["master"] == "local[2]" and asked["spark.sql.shuffle.partitions"] == "4"


def test_partitions_follow_the_input_without_a_cap():
    a, b = (int(S.cluster_settings(tb << 40, 8000)["spark.sql.shuffle.partitions"]) for tb in (25, 100))
    assert b == 4 * a and (100 << 40) / b <= 128 << 20

"""Written tables: where they stand, and that they go."""

import os

import pytest

from tessera import tables


class Conf(dict):
    def set(self, key, value):
        self[key] = value


class Session:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x", ""])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        tables.shared_folder(Session(spark_master=master))
    assert tables.shared_folder(Session(spark_master=master, spark_checkpoint_dir="hdfs://x/y")) == "hdfs://x/y"


def test_local_sessions_get_a_temporary_folder():
    session = Session(spark_master="local[2]")
    found = tables.shared_folder(session)
    assert os.path.isdir(found) and tables.shared_folder(session) == found


def test_drop_deletes_the_step_before(spark):
    one = tables.durable(spark.range(5), "one")
    two = tables.durable(one.selectExpr("id + 1 AS id"), "two")
    path = one._tessera_path
    tables.drop(one)
    assert not os.path.exists(path.removeprefix("file:")) and two.count() == 5
    tables.drop(spark.range(3))  # not written: nothing happens

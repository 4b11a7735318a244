"""Where intermediate tables may be written."""

from __future__ import annotations

import os

import pytest

from pricetrail import session


class Cluster:
    """As much of a session as the folder rule reads."""

    def __init__(self, master: str, folder: str = "") -> None:
        self.sparkContext = type("Context", (), {"master": master})()
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}


def test_a_cluster_must_name_its_folder():
    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(Cluster(master))
        assert session.shared_folder(Cluster(master, "hdfs://shared")) == "hdfs://shared"


def test_local_sessions_have_one_of_their_own():
    for master in ("local", "local[*]", "local[8]"):
        folder = session.shared_folder(Cluster(master))
        assert os.path.isdir(folder) and session.shared_folder(Cluster(master)) == folder


def test_settled_tables_lie_there(spark):
    out = session.settle(spark.range(3))
    assert out.count() == 3 and out.inputFiles()[0].removeprefix("file://").startswith(session.shared_folder(spark))

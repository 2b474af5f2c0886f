"""The folder handed from job to job, as sessions of a cluster name it."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from souba.session import shared_dir


def _session(master: str, **settings: str):
    chosen = []
    context = SimpleNamespace(master=master, applicationId="app", getConf=lambda: settings, setCheckpointDir=chosen.append)
    return SimpleNamespace(sparkContext=context), chosen


@pytest.mark.parametrize("named", ["/tmp/checkpoints", "/tmp/checkpoints/", "file:///tmp/checkpoints", "hdfs://nn/checkpoints"])
def test_a_cluster_names_the_shared_folder_with_or_without_a_scheme(named):
    spark, chosen = _session("spark://host:7077", **{"spark.checkpoint.dir": named})
    assert shared_dir(spark) == named.rstrip("/")
    assert chosen == [named]


def test_a_cluster_without_a_shared_folder_is_refused():
    spark, _ = _session("local-cluster[3,4,10240]")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(spark)

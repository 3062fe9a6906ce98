"""Stored tables: only a local master may go without a shared folder, and clean-up removes what was stored."""

from types import SimpleNamespace

import pytest

from strataframe.plans import storage


def test_cluster_without_shared_folder_is_refused():
    context = SimpleNamespace(master="local-cluster[2,1,1024]", getCheckpointDir=lambda: None)
    conf = SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(SimpleNamespace(sparkContext=context, conf=conf))


def test_local_masters():
    assert [storage.is_local(m) for m in ("local", "local[8]", "local-cluster[3,2,1024]", "yarn")] == [True, True, False, False]


def test_clean_up(spark):
    storage.clean_up(spark)
    table = storage.materialise(spark.range(3), "gone")
    assert table.count() == 3
    assert storage.clean_up(spark) == 1
    assert storage.clean_up(spark) == 0

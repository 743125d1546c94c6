import os
from types import SimpleNamespace

import pytest

from textloom import storage


def test_tables_are_written_and_cleared(spark):
    kept = list(storage._WRITTEN)
    storage._WRITTEN.clear()
    a = storage.stash(spark.range(5).toDF("x"), "t")
    b = storage.stash_bucketed(spark.range(7).toDF("x"), "t", "x")
    paths = list(storage._WRITTEN)
    assert (a.count(), b.count()) == (5, 7) and all(os.path.isdir(p) for p in paths)
    assert not spark.catalog.listTables() or all("t_" not in t.name for t in spark.catalog.listTables())
    assert storage.clear(spark) == 2 and not any(os.path.exists(p) for p in paths)
    storage._WRITTEN.extend(kept)


def test_a_cluster_needs_a_shared_folder():
    conf = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: {"spark.master": master}.get(key, default)))
    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            storage.shared_dir(conf(master))
    assert os.path.isdir(storage.shared_dir(conf("local[2]")))

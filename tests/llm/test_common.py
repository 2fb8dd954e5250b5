from types import SimpleNamespace

import pytest

from objekta.llm import common


def session(folder, master):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))


def test_scratch_tables_go_to_the_shared_folder():
    assert common.shared_dir(session("/shared", "spark://host:7077")) == "/shared"
    with pytest.raises(RuntimeError):
        common.shared_dir(session(None, "spark://host:7077"))
    assert common.shared_dir(session(None, "local[4]")) == common.shared_dir(session(None, "local[2]"))


def test_tables_and_shuffle_files(spark):
    first = common.cut(spark.range(10).repartition(3), "test-first")
    second = common.cut(first.groupBy((first.id % 3).alias("k")).count(), "test-second", first)
    assert {(r.k, r["count"]) for r in second.collect()} == {(0, 4), (1, 3), (2, 3)}
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FileNotFound|FAILED_READ_FILE"):
        spark.read.parquet(first.cut_path).count()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"

"""Where shared data goes."""

from types import SimpleNamespace

import pytest

from gatewell.session import materialize, scratch_path, shared_dir


def session(master, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)),
                           sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_shared_dir_is_the_configured_one():
    configured = {"spark.checkpoint.dir": "hdfs://shared/checkpoints/"}
    assert shared_dir(session("yarn", **configured)) == "hdfs://shared/checkpoints"
    assert scratch_path(session("yarn", **configured), "x").startswith(
        "hdfs://shared/checkpoints/gatewell/app-yarn/x-")


def test_only_local_sessions_may_use_a_temporary_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session("yarn"))
    assert shared_dir(session("local[2]")) == shared_dir(session("local[2]"))


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, `a b.c` string")
    stored = materialize(df, "t")
    assert stored.schema == df.schema and sorted(stored.collect()) == sorted(df.collect())

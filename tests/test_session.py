from types import SimpleNamespace

import pytest

from starling.session import checkpoint_folder, settled


def stand_in(named=None, in_use=None, master="spark://head:7077"):
    """Settings of a session: the checkpoint folder can only be named before a real one starts."""
    context = SimpleNamespace(master=master, chosen=in_use)
    context.getCheckpointDir = lambda: context.chosen
    context.setCheckpointDir = lambda folder: setattr(context, "chosen", folder)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named or default))


def test_named_folder_is_used():
    session = stand_in(named="hdfs://shared/ck")
    assert checkpoint_folder(session) == session.sparkContext.chosen == "hdfs://shared/ck"
    running = stand_in(named="hdfs://shared/ck/", in_use="hdfs://shared/ck/1f3a")
    assert checkpoint_folder(running) == "hdfs://shared/ck/" and running.sparkContext.chosen.endswith("1f3a")


def test_no_folder_is_made_up_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_folder(stand_in())
    assert checkpoint_folder(stand_in(in_use="hdfs://elsewhere")) == "hdfs://elsewhere"


def test_folders_are_told_apart_exactly():
    for named, in_use, kept in (("/data/ck", "/data/ck2/1f", False), ("/data/ck", "file:/data/ck/1f", True),
                                ("hdfs://a/ck", "hdfs://b/ck/1f", False), ("file:///data/ck", "file:/data/ck/1f", True)):
        session = stand_in(named=named, in_use=in_use)
        assert checkpoint_folder(session) == named
        assert (session.sparkContext.chosen == in_use) == kept


def test_local_master_keeps_to_its_own_tables_folder():
    session = stand_in(master="local[2]")
    assert checkpoint_folder(session) == session.sparkContext.chosen == "spark-warehouse/_checkpoints"


def test_settled_frames_come_from_files(spark):
    doubled = settled(spark.range(10).selectExpr("id * 2 AS x"))
    assert doubled.count() == 10
    assert "Scan ExistingRDD" in doubled._jdf.queryExecution().executedPlan().toString()
    assert checkpoint_folder(spark) == checkpoint_folder(spark)

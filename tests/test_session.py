import os

from lawloom import session


def test_materialize_and_release(spark):
    df = session.materialize(spark.range(10), "t")
    path = session._WRITTEN[-1]
    assert df.count() == 10 and os.path.isdir(path.removeprefix("file:"))
    assert session.release(spark) >= 1 and not os.path.exists(path.removeprefix("file:")) and session._WRITTEN == []


def test_shared_folder_comes_from_the_session(spark):
    given = spark.conf.get("spark.checkpoint.dir", None)
    assert session.shared_dir(spark) == (given or spark.conf.get("lawloom.checkpoint.dir"))


def test_spread(spark):
    assert session.spread(spark.range(5).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(50).repartition(9)
    assert session.spread(wide).rdd.getNumPartitions() == 9

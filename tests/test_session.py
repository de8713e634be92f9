from mossgrid import session


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_cut_lineage_and_spread(spark):
    df = session.cut(spark.range(10).repartition(3))
    assert df.count() == 10 and "ExistingRDD" in df._jdf.queryExecution().toString()
    assert session.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(0, 10, 1, 50)).rdd.getNumPartitions() == 50

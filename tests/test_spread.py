"""Work is dealt to all cores, wherever a scan's rows are."""

from datebook.plans.derived import cal_events, spread


def test_one_row_group_goes_to_all_cores(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(4000).coalesce(1).write.parquet(path)
    # Cut into as many partitions as there are cores, of which one has the row group.
    rows = spread(spark.read.option("maxPartitionBytes", 1000).parquet(path).union(spark.range(0).repartition(4)))
    sizes = rows.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert len(sizes) >= 4 and max(sizes) < 2000
    assert cal_events(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4

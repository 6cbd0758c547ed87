from pyspark.sql import functions as F

from marquee.operators.arrays import Members, Relation, arrays_by_item


def test_all_arrays_come_from_one_grouping_of_rows_shuffled_once(spark):
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13)], "movie_id int, k int")
    entities = spark.createDataFrame([(10, "b"), (11, "a"), (12, None)], "id int, name string")
    cast = spark.createDataFrame([(1, 2, "x"), (1, 1, None), (4, 3, "z")], "movie_id int, n int, role string")
    found = arrays_by_item({"names": Relation(links, "k", entities)}, {"cast": Members(cast, ["n", "role"], [F.col("n")])})
    # Nothing is gathered before the shuffle: both steps of the grouping stand above it.
    physical = found._jdf.queryExecution().executedPlan().toString()
    groupings, shuffle = [i for i in range(len(physical)) if physical.startswith("ObjectHashAggregate(", i)], physical.index("REPARTITION_BY_COL")
    assert len(groupings) == 2 and max(groupings) < shuffle
    assert {(r[0], tuple(r[1]), tuple(map(tuple, r[2]))) for r in found.collect()} == {
        (1, ("a", "b"), ((1, None), (2, "x"))), (2, (None,), ()), (4, (), ((3, "z"),)),
    }


def test_a_large_file_is_scanned_in_small_parts(spark, tmp_path):
    path = str(tmp_path / "links")
    spark.range(20_000_000, numPartitions=1).write.option("compression", "none").option("parquet.block.size", 1 << 20).option("parquet.enable.dictionary", "false").parquet(path)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
    try:
        assert spark.read.parquet(path).rdd.getNumPartitions() >= 4
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")

import os

from sylva.sources.partitions import certainly_empty, spread
from sylva.staging import discard, settle


def test_settled_tables_are_files_until_they_are_discarded(spark):
    t = settle(spark.range(5), "five", 1, codec="zstd")
    folder = t.settled_at.removeprefix("file:")
    assert t.count() == 5 and any(f.endswith(".zstd.parquet") for f in os.listdir(folder))
    discard(t, spark.range(3))
    assert not os.path.exists(folder)
    discard(t)


def test_spreading_looks_at_the_plan_and_not_at_names(spark):
    few = spark.range(10, numPartitions=1).withColumnRenamed("id", "Sort")
    assert spread(few.selectExpr("`Sort` as `Join`")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    grouped = few.groupBy("Sort").count()
    assert spread(grouped) is grouped


def test_plans_without_rows(spark):
    t = spark.createDataFrame([(1, "json")], "k int, language string")
    assert certainly_empty(t.selectExpr("k", "'json' as language").where("language = 'text'")) and not certainly_empty(t)


def test_temporary_folders_are_new_and_shared(spark):
    from sylva.staging import shared_dir, temporary

    a, b = temporary(spark, "x"), temporary(spark, "x")
    assert a != b and a.startswith(shared_dir(spark))
    spark.range(3).write.parquet(f"{a}/all")
    assert spark.read.parquet(f"{a}/all").count() == 3

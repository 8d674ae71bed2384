"""The table by key: versions, runs that count once, touched buckets, commits."""

import pytest
from pyspark.sql import functions as F

from vigil.sources.stored import KeyedTable
from vigil.streaming.storage import new_folder

SCHEMA = "k string, n bigint"


def table(spark, path=None, buckets=4):
    return KeyedTable(spark, path or new_folder(spark, "store"), spark.createDataFrame([], SCHEMA).schema, ["k"], buckets)


def add(both):
    return both.groupBy("k").agg(F.sum("n").alias("n"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_runs_add_up_and_count_once(spark):
    t = table(spark)
    assert t.version == 0 and rows(t.read()) == []
    one = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 5)], SCHEMA)
    assert t.upsert(one, add, "one") and not t.upsert(one, add, "one")
    two = spark.createDataFrame([("a", 10), ("c", 1), (None, 5)], "k string, n int")
    assert t.upsert(two, add, "two")
    assert rows(t.read()) == [("a", 14), ("b", 2), ("c", 1), (None, 10)]
    assert rows(t.read(1).where("k = 'a'")) == [("a", 4)] and t.version == 2


def test_only_touched_buckets_are_rewritten_and_read(spark):
    t = table(spark, buckets=8)
    t.upsert(spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("n")), add, "all")
    before = t._manifest()[1]
    t.upsert(spark.createDataFrame([("7", 1)], SCHEMA), add, "one key")
    after = t._manifest()[1]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    found = t.find(spark.createDataFrame([("7",), ("none",)], "k string"))
    assert rows(found) == [("7", 2)] and len({f.rsplit("/", 1)[0] for f in found.inputFiles()}) <= 2


def test_a_run_that_died_before_its_manifest_leaves_nothing(spark):
    t = table(spark)
    t.upsert(spark.createDataFrame([("a", 1)], SCHEMA), add, "one")

    def dies(both):
        spark.createDataFrame([("a", 99)], SCHEMA).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{t.path}/data/half")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        t.upsert(spark.createDataFrame([("a", 1)], SCHEMA), dies, "two")
    # a manifest without its mark of success is none
    spark.createDataFrame([({0: "x"}, ["two"], 4)], "folders map<int,string>, runs array<string>, buckets int").coalesce(1).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{t.path}/manifest/version=9")
    assert rows(t.read()) == [("a", 1)]
    assert t.upsert(spark.createDataFrame([("a", 1)], SCHEMA), add, "two") and rows(t.read()) == [("a", 2)]


def test_two_writers_of_one_version_collide(spark):
    path = new_folder(spark, "store")
    a, b = table(spark, path), table(spark, path)

    def other_first(both):
        b.upsert(spark.createDataFrame([("a", 5)], SCHEMA), add, "other")
        return add(both)

    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        a.upsert(spark.createDataFrame([("a", 1)], SCHEMA), other_first, "mine")
    assert a.upsert(spark.createDataFrame([("a", 1)], SCHEMA), add, "mine") and rows(a.read()) == [("a", 6)]


def test_the_number_of_buckets_holds(spark):
    path = new_folder(spark, "store")
    table(spark, path).upsert(spark.createDataFrame([("a", 1)], SCHEMA), add, "one")
    with pytest.raises(ValueError, match="4 buckets"):
        table(spark, path, buckets=16).read()


def test_an_empty_run_is_a_version(spark):
    t = table(spark)
    assert t.upsert(spark.createDataFrame([], SCHEMA), add, "none") and t.version == 1 and t.read().isEmpty()
    assert not t.upsert(spark.createDataFrame([("a", 1)], SCHEMA), add, "none")

"""Pieces of an input: one for every core, more for a larger one."""

from pyspark.sql import functions as F

from lumenframe.plans.spread import PIECE_BYTES, dealt, pieces, spread


def test_pieces_grow_with_the_rows_of_texts(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    many = cores * 3 * PIECE_BYTES // 4096
    spark.range(0, many, 1, 1).select("id", F.repeat(F.lit("x"), 4088).alias("text")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))  # a small file: the texts are equal
    assert spread(table).rdd.getNumPartitions() == dealt(table).rdd.getNumPartitions() == 3 * cores
    assert pieces(table.limit(10)) == cores and dealt(table.limit(10)).rdd.getNumPartitions() == 1
    assert spread(table).agg(F.count("*"), F.sum("id")).first()[:] == (many, many * (many - 1) // 2)


def test_an_input_of_more_than_a_gigabyte_is_dealt_too(spark):
    assert pieces(spark.range(1 << 28)) == 512  # 2 GiB by estimate


def test_rows_of_no_known_size(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    cores = spark.sparkContext.defaultParallelism
    assert pieces(rows) == pieces(rows.crossJoin(rows.select("id"))) == pieces(rows.where("id > 5")) == cores
    assert sorted(r.id for r in spread(rows.select("id")).collect()) == [1, 2]

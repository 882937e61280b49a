"""Resumable work, on tables and on streams."""

from pyspark.sql import functions as F

from verdance.functions.bands import BandCatalog
from verdance.operators import stats
from verdance.sources import fixtures, rasters
from verdance.streaming import incremental

DIR = "/root/testdata/sf0.001"


def doubled(df):
    return df.withColumn("twice", F.col("v") * 2)


def test_only_new_objects_are_processed(spark, tmp_path):
    out = str(tmp_path / "out")
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "fid long, v double")
    incremental.append_new(a, out, doubled)
    incremental.append_new(a.unionByName(spark.createDataFrame([(3, 3.0)], a.schema)).withColumn("v", F.col("v") + 10), out, doubled)
    assert {r.fid: r.twice for r in spark.read.parquet(out).collect()} == {1: 2.0, 2: 4.0, 3: 26.0}


def test_stream_adds_each_object_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    first = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 2.0)], "fid long, v double")
    first.write.parquet(source)
    stream = lambda: spark.readStream.schema(first.schema).parquet(source)
    incremental.follow(stream(), out, doubled, mark).awaitTermination()
    spark.createDataFrame([(2, 9.0), (3, 3.0)], first.schema).write.mode("append").parquet(source)
    incremental.follow(stream(), out, doubled, mark).awaitTermination()
    assert sorted((r.fid, r.twice) for r in spark.read.parquet(out).collect()) == [(1, 2.0), (2, 4.0), (3, 6.0)]


def test_indices_are_written_by_name(spark, tmp_path):
    pixels = fixtures.spectra(spark, DIR)
    assert len(rasters.write_indices(pixels, ["NDVI", "SR"], str(tmp_path))) == 2
    assert rasters.write_indices(pixels, ["NDVI", "SR", "CI"], str(tmp_path), overwrite=False) == [f"{tmp_path}/CI"]
    assert spark.read.parquet(f"{tmp_path}/SR").columns == ["pixel_id", "SR"]
    assert len(BandCatalog.of(pixels).bands) == 64


def test_features_sampled_over_strata(spark):
    df = fixtures.attributes(spark, DIR)
    out = stats.sample_features(df, 20, "id", ignore="brand")
    assert out.count() == 20 and out.columns == df.columns

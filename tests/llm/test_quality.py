"""op9: held-out accuracy, and defined results of edge rows."""

from pyspark.sql import functions as F

from trafficlens.llm import quality
from trafficlens.llm.queries import op9
from tests.conftest import SF


def test_held_out_accuracy(spark):
    sf = SF.replace("0.01", "0.1")
    out = op9(spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = out.where("held_out").join(labels, "doc_id")
    n, good, low, high = held.select(F.count("*"), F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.min("score"), F.max("score")).first()
    assert n > 1000 and good / n >= 0.99 and 0 <= low and high <= 1
    assert out.where("predicted <> cast(score >= 0.5 as int)").count() == 0
    by_crc = out.where("held_out <> (crc32(cast(cast(doc_id as string) as binary)) % 3 = 1)")
    assert by_crc.count() == 0


def test_held_out_labels_are_never_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, flipped)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "text " * 5, 3), (3, "word " * 40000, 4), (3, "word " * 40000, 4)],
                                 "doc_id long, text string, score long")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.report(docs, none).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5}
    one = spark.createDataFrame([(2, 1, 0), (3, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.report(docs, one).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    both = spark.createDataFrame([(2, 1, 0), (3, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.report(docs, both).collect()) == 5
    assert quality.report(docs.limit(0), both).count() == 0
    assert quality.keep_good(docs, none).columns == docs.columns

"""Drawn documents of large groups."""

from pyspark.sql import functions as F

from fiberloom.sources import kml


def test_a_large_group_falls_into_several_documents(spark, monkeypatch):
    monkeypatch.setattr(kml, "PART", 50)
    point = F.array(F.struct(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y")))
    folder = F.when(F.col("id") < 200, F.lit("a;one")).otherwise(F.concat(F.lit("a;"), (F.col("id") % 40).cast("string")))
    rows = spark.range(400).select(F.when(F.col("id") < 390, "big").alias("region"), folder.alias("folders"), F.col("id").cast("string").alias("name"), F.lit("point").alias("kind"), point.alias("line"), F.create_map(F.lit("k"), F.lit("v")).alias("data"))
    made = kml.documents(rows, "region").cache()
    counts = {r["path"]: r["count"] for r in made.groupBy("path").count().collect()}
    assert counts["big"] > 1 and counts["None"] == 1
    back = kml.parse(made)
    assert max(r[0].count(b"<Placemark>") for r in made.select("content").collect()) < 120
    kept = lambda df: sorted(tuple(r) for r in df.select("folders", "name", F.col("line")[0]["x"], F.col("data")["k"]).collect())
    assert kept(back) == kept(rows)

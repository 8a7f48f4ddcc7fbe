"""Streams of site reports: an extension, so that a feed can keep the planning tables fresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITE = "site_id string, site_type string, x double, y double, reported timestamp"


def site_feed(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """Reports from parquet files that arrive in a folder; repeats of a report within the watermark go."""
    reports = spark.readStream.schema(SITE).parquet(folder).withWatermark("reported", late)
    return reports.where("site_id is not null").dropDuplicatesWithinWatermark(["site_id", "reported"])


def reports_by_cell(feed: DataFrame, every: str = "10 minutes", cell: float = 10_000.0) -> DataFrame:
    """Reports of each grid cell in tumbling windows; state goes once the watermark has passed a window."""
    place = F.concat_ws("_", F.floor(F.col("x") / cell), F.floor(F.col("y") / cell))
    return feed.groupBy(F.window("reported", every).alias("w"), place.alias("cell")).agg(F.count(F.lit(1)).alias("reports")).select("w.start", "w.end", "cell", "reports")

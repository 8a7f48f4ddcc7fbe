from fiberloom.streaming.feed import SITE, reports_by_cell, site_feed


def test_windows_of_a_site_feed(spark, tmp_path):
    rows = [("a", "t", 1.0, 1.0, "2024-01-01 00:01:00"), ("a", "t", 1.0, 1.0, "2024-01-01 00:01:00"), ("b", "t", 20000.0, 1.0, "2024-01-01 00:02:00"), (None, "t", 1.0, 1.0, "2024-01-01 00:03:00"), ("z", "t", 1.0, 1.0, "2024-01-02 00:00:00")]
    table = spark.createDataFrame(rows, SITE.replace("timestamp", "string"))
    table.selectExpr("site_id", "site_type", "x", "y", "cast(reported as timestamp) reported").write.parquet(str(tmp_path / "in"))
    query = (
        reports_by_cell(site_feed(spark, str(tmp_path / "in")))
        .writeStream.format("memory").queryName("cells").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {(str(r["start"])[11:16], r["cell"], r["reports"]) for r in spark.sql("select * from cells").collect()}
    assert ("00:00", "0_0", 1) in got and ("00:00", "2_0", 1) in got

"""Checks and preparation of what a job is given: tables, drawn points and lines, earlier designs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fiberloom.operators import tables
from fiberloom.operators.rings import is_hub

NEW_RING = {
    "supervised": ("site_id", "site_name", "site_type", "lat", "long", "region", "ring_name", "flag"),
    "unsupervised": ("site_id", "site_name", "site_type", "lat", "long", "region"),
}
INSERT_SHEETS = ("New Sites", "Existing Sites", "Hub Sites")


def required(df: DataFrame, columns, what: str) -> None:
    """``ValueError`` that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")


def new_ring(df: DataFrame, method: str) -> DataFrame:
    """Sites of a new design with their ids, names and regions as text, in their own columns only."""
    if method not in NEW_RING:
        raise ValueError(f"method must be one of {sorted(NEW_RING)}")
    required(df, NEW_RING[method], method)
    return df.withColumns({c: tables.text(c) for c in ("site_id", "site_name", "region")})


def without_hubs(sites: DataFrame, hubs: DataFrame) -> DataFrame:
    """Sites whose id is no hub's; a site without an id stays."""
    ids = hubs.where("site_id is not null").select(F.col("site_id").cast("string").alias("__hub")).distinct()
    return sites.join(ids, F.col("site_id").cast("string") == F.col("__hub"), "left_anti")


def insert_sheets(sheets: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New, existing and hub sites of an insertion workbook, validated; ``ValueError`` where a sheet is missing or empty."""
    missing = [n for n in INSERT_SHEETS if n not in sheets]
    if missing:
        raise ValueError(f"missing sheets {missing}")
    for n in INSERT_SHEETS:
        required(sheets[n], ("site_id", "site_name", "long", "lat"), n)
        if sheets[n].isEmpty():
            raise ValueError(f"{n}: no rows")
    return tuple(sheets[n] for n in INSERT_SHEETS)


def _of_folders(rows: DataFrame) -> DataFrame:
    part = tables.split_folders(F.col("folders"))
    return rows.withColumn("ring_name", part["ring_last"]).withColumn("program", part["program"]).withColumn("region", tables.region_code(F.col("folders")))


def drawn_sites(points: DataFrame) -> DataFrame:
    """Sites of drawn placemarks (``name, folders, x, y``): what is no connection; a last folder that speaks of a hub makes one."""
    required(points, ("name", "folders", "x", "y"), "points")
    rows = _of_folders(points.where(~F.lower("name").contains("connection")))
    kind = F.when(is_hub(tables.split_folders(F.col("folders"))["site_type"]), "FO Hub").otherwise("Site List")
    label = F.col("Site_Name") if "Site_Name" in points.columns else F.col("name")
    return rows.select(F.col("name").alias("site_id"), label.alias("site_name"), kind.alias("site_type"), "x", "y", "ring_name", "program", "region")


def drawn_routes(lines: DataFrame, sep: str = "-") -> DataFrame:
    """Segments of drawn lines (``name, folders, folder_name, line``) in folders of routes; the ends are the name's first and last part."""
    required(lines, ("name", "folders", "folder_name", "line"), "lines")
    rows = _of_folders(lines.where(F.lower("folder_name").contains("route")))
    parts = F.split("name", F.lit(f"\\Q{sep}\\E"))
    return rows.select(F.col("name").alias("segment"), F.get(parts, F.lit(0)).alias("near_end"), F.try_element_at(parts, F.lit(-1)).alias("far_end"), "ring_name", "program", "region", "line")


def insertion(sites: DataFrame, points: DataFrame, lines: DataFrame, sep: str = "-") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sites to insert, existing sites and existing segments; ``ValueError`` where one of the drawn layers is empty."""
    required(sites, ("site_id", "site_name", "long", "lat"), "insert sites")
    existing, segments = drawn_sites(points), drawn_routes(lines, sep)
    for rows, what in ((existing, "points"), (segments, "lines")):
        if rows.isEmpty():
            raise ValueError(f"the existing {what} are empty")
    return sites.withColumn("site_type", F.lit("Site List")), existing, segments


def earlier_design(rows: DataFrame, sep: str = "-") -> DataFrame:
    """Segments of an earlier design (``name, site_type``) without its connection rows, types mapped, ends split off the name."""
    kept = rows.where(~F.lower("name").contains("connection"))
    parts = F.split("name", F.lit(f"\\Q{sep}\\E"))
    kind = F.when(is_hub(F.col("site_type")), "FO Hub").otherwise("Site List")
    return kept.withColumn("site_type", kind).withColumn("near_end", F.trim(F.get(parts, F.lit(0)))).withColumn("far_end", F.trim(F.try_element_at(parts, F.lit(-1))))


def start_of_ring(points: DataFrame, segments: DataFrame) -> DataFrame:
    """``ring_name, start_hub, start_column``: where a ring's connections are followed from.

    The first segment's near end that is a hub of the ring; failing that the first far end; failing
    that the first hub of the points, from the near end. Rings without a hub have none and are left out.
    ``points`` has ``ring_name, site_id, site_type, seq``, ``segments`` ``ring_name, near_end, far_end, seq``.
    """
    hubs = points.where(is_hub(F.col("site_type"))).select("ring_name", F.col("site_id").alias("hub"), "seq")

    def first(end: str) -> DataFrame:
        met = segments.select("ring_name", F.col(end).alias("hub"), F.col("seq").alias("at")).join(hubs.select("ring_name", "hub").distinct(), ["ring_name", "hub"])
        return met.groupBy("ring_name").agg(F.min_by("hub", F.struct("at", "hub")).alias(end))

    any_ = hubs.groupBy("ring_name").agg(F.min_by("hub", F.struct("seq", "hub")).alias("any"))
    out = any_.join(first("near_end"), "ring_name", "left").join(first("far_end"), "ring_name", "left")
    column = F.when(F.col("near_end").isNull() & F.col("far_end").isNotNull(), "far_end").otherwise("near_end")
    return out.select("ring_name", F.coalesce("near_end", "far_end", "any").alias("start_hub"), column.alias("start_column"))


def large_enough(rows: DataFrame, cluster: str, least: int = 1) -> DataFrame:
    """Rows of clusters of at least ``least`` members; cluster -1 is noise and goes."""
    n = F.count(F.lit(1)).over(Window.partitionBy(cluster))
    return rows.where(F.col(cluster) != -1).withColumn("__n", n).where(F.col("__n") >= least).drop("__n")

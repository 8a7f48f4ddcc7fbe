"""Adaptive partitions of a table by time: years, months, days and hours, as fine as their rows demand.

A time with more rows than the limit is cut into all its months, days or hours; neighbours that fit
together are one leaf. A leaf's rows lie in order in files of the limit, one Parquet file for each
part. Places within a leaf come from two levels: the table is dealt once into key ranges, a
leaf and a range are a bucket, rows are numbered only within their bucket, and the sums of the
bucket counts before it give the rest. So no leaf, however large, is ever in one window.

Writing more rows later changes only the files whose rows change.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from fiberloom.llm.common import fresh
from fiberloom.runtime import durable, scratch

#: Nodes of the tree that may be broadcast, each of a few numbers and a short text (some 10 MB); with more, rows and nodes are shuffled.
NODES = 100_000
#: Buckets whose counts are summed up in one window, and groups of buckets in the next one.
SUMMED = 1_024

#: Key ranges at least, and rows of one at most, about.
RANGES, RANGE = 16, 100_000
#: Key ranges at most: with more rows each holds more of them, and its task spills.
MOST_RANGES = 50_000

LEVELS = ("year", "month", "day", "hour")
NULL = "null"


def free(stem: str, columns: list[str]) -> str:
    """``stem``, lengthened until no column has the name in whatever case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def node(moment: Column, level: str) -> Column:
    """Number of the year, of the month, of the day or of the hour that a timestamp without a zone lies in."""
    day = F.datediff(moment.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    year = F.year(moment).cast("long")
    return {"year": year, "month": year * 12 + F.month(moment) - 1, "day": day, "hour": day * 24 + F.hour(moment)}[level]


def _date(day: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))


def _first_day(month: Column) -> Column:
    return F.make_date(F.floor(month / 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1))


def _day_number(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long")


def _siblings(hours: DataFrame, limit: int) -> DataFrame:
    """``level, parent, node, n, path, member``: every node that is reached, empty ones too.

    ``hours`` has ``hour, n``. Only the counts of hours that hold rows are aggregated; children are
    made for the nodes above the limit alone, of which there are no more than rows by limit.
    """
    day = F.floor(F.col("hour") / 24)
    days = durable(hours.groupBy(day.alias("node")).agg(F.sum("n").alias("n")).withColumn("d", _date(F.col("node"))))
    year, month = F.year("d").cast("long"), F.year("d").cast("long") * 12 + F.month("d") - 1
    counts = {
        "year": days.groupBy(year.alias("node")).agg(F.sum("n").alias("n")),
        "month": days.groupBy(month.alias("node")).agg(F.sum("n").alias("n")),
        "day": days.select("node", "n"),
        "hour": hours.select(F.col("hour").alias("node"), "n"),
    }
    span = counts["year"].agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a is not null")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    member = {
        "year": F.lpad(F.col("node").cast("string"), 4, "0"),
        "month": two(F.pmod("node", F.lit(12)) + 1),
        "day": two(F.dayofmonth(_date(F.col("node")))),
        "hour": two(F.pmod("node", F.lit(24))),
    }
    children = {
        "month": (F.col("parent") * 12, F.col("parent") * 12 + 11),
        "day": (_day_number(_first_day(F.col("parent"))), _day_number(_first_day(F.col("parent") + 1)) - 1),
        "hour": (F.col("parent") * 24, F.col("parent") * 24 + 23),
    }
    out, above = None, None
    for level in LEVELS:
        if level == "year":
            listed = span.select(F.lit(0).cast("long").alias("parent"), F.lit("").alias("path"), F.explode(F.sequence("a", "b")).alias("node"))
        else:
            listed = above.select("parent", "path", F.explode(F.sequence(*children[level])).alias("node"))
        found = listed.join(counts[level], "node", "left").select(F.lit(level).alias("level"), "parent", "node", F.coalesce("n", F.lit(0)).alias("n"), "path", member[level].alias("member"))
        found = durable(found)
        above = found.where(F.col("n") > limit).select(F.col("node").alias("parent"), F.concat("path", "member", F.lit("/")).alias("path"))
        out = found if out is None else out.unionByName(found)
    return out


def leaves(hours: DataFrame, limit: int) -> DataFrame:
    """``level, node, leaf, start``: the leaf of each node that is not cut further, and the first node of its run.

    Siblings in order of time join the run before them while it stays within the limit. The
    children of one node are at most 31; years are as many as the calendar has between the first
    and the last moment.
    """

    def runs(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        level, path = rows["level"].iloc[0], rows["path"].iloc[0]
        found, run, held = [], [], 0

        def close() -> None:
            if run:
                name = f"{path}{run[0][1]}-{run[-1][1]}"
                found.extend((level, at, name, run[0][0]) for at, _ in run)

        for at, n, member in zip(rows["node"], rows["n"], rows["member"], strict=True):
            fits = run and held + n <= limit
            if not fits:
                close()
                run, held = [], 0
            if n <= limit or level == "hour":
                run.append((at, member))
                held += n
        close()
        return pd.DataFrame(found, columns=["level", "node", "leaf", "start"])

    return durable(_siblings(hours, limit).groupBy("level", "parent").applyInPandas(runs, "level string, node long, leaf string, start long"))


def placed_in(rows: DataFrame, moment: Column, tree: DataFrame, leaf: str) -> DataFrame:
    """Append the leaf of each row by its year, month, day or hour, whichever the tree has."""
    small = tree.count() <= NODES
    found = []
    for level in LEVELS:
        key, name = fresh(level), fresh("leaf")
        found.append(name)
        side = tree.where(F.col("level") == level).select(F.col("node").alias(key), F.col("leaf").alias(name))
        rows = rows.join(F.broadcast(side) if small else side, node(moment, level) == F.col(key), "left").drop(key)
    return rows.withColumn(leaf, F.coalesce(*found, F.lit(NULL))).drop(*found)


def _before(counts: DataFrame) -> DataFrame:
    """``leaf, bucket, before``: rows of the leaf in earlier buckets, summed in groups of buckets."""
    grouped = counts.withColumn("g", F.floor(F.col("bucket") / SUMMED))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("leaf", "g").agg(F.sum("n").alias("n"))
    groups = groups.select("leaf", "g", F.coalesce(F.sum("n").over(earlier("leaf", "g")), F.lit(0)).alias("base"))
    within = grouped.withColumn("own", F.coalesce(F.sum("n").over(earlier("leaf", "g", "bucket")), F.lit(0)))
    return within.join(groups, ["leaf", "g"]).select("leaf", "bucket", (F.col("base") + F.col("own")).alias("before"))


def ranked(rows: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """Append ``part`` to rows with ``leaf`` and ``bucket``: rows are numbered within their bucket only."""
    counts = rows.groupBy("leaf", "bucket").agg(F.count(F.lit(1)).alias("n"))
    numbered = rows.withColumn("rn", F.row_number().over(Window.partitionBy("leaf", "bucket").orderBy(*order)))
    joined = numbered.join(_before(counts), ["leaf", "bucket"])
    return joined.withColumn("part", F.floor((F.col("before") + F.col("rn") - 1) / limit) + 1).drop("rn", "before")


def _hash(columns: list[tuple[str, str]], *seed: Column) -> Column:
    """Hash of a whole row, telling nulls apart and taking maps as JSON."""
    values = [F.to_json(F.struct(f"`{c}`")) if "map<" in t else F.col(f"`{c}`") for c, t in columns]
    nulls = [F.when(F.col(f"`{c}`").isNull(), F.lit(1 << i % 60).cast("long")).otherwise(F.lit(0).cast("long")) for i, (c, _) in enumerate(columns)]
    masks = [sum(nulls[i + 1 : i + 60], nulls[i]) for i in range(0, len(nulls), 60)]
    return F.xxhash64(*seed, *values, *masks)


class TimeParts:
    """A table in one folder, as the class' module describes.

    ``rows`` is cut by ``moment``, a timestamp (one with a zone counts in the session's), and ordered by
    it, then by the columns ``order``, nulls first; rows equal in all of these follow a hash of the
    whole row, so that reruns agree. Rows without a moment are the leaf ``null``. A third of the rows
    may share one moment, or all values: their parts are still cut evenly. An empty table writes no
    file. Files hold the columns of the table and nothing else; what the method adds is named apart
    from them. ``limit`` is the number of rows of a file at most.
    """

    def __init__(self, folder: str, rows: DataFrame, moment: Column, order: list[str], limit: int):
        self.folder, self.limit, self.spark = folder, limit, rows.sparkSession
        self.columns, self.schema = rows.columns, rows.schema
        self.types = rows.dtypes
        self.leaf_dir, self.part_dir = free("leaf", rows.columns), free("part", rows.columns)
        self.own = [f"c{i}" for i in range(len(rows.columns))]
        self.ranged = self._ranged(rows, moment, order)

    def _ranged(self, rows: DataFrame, moment: Column, order: list[str]) -> DataFrame:
        """The table in key ranges, written once: plain names ``c0...``, ``moment``, ``tie`` and ``bucket``."""
        plain = rows.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(self.columns, self.own, strict=True)], moment.cast("timestamp_ntz").alias("moment"))
        plain = plain.withColumn("tie", _hash(self._typed()))
        self.order = ["moment", *[self.own[self.columns.index(c)] for c in order], "tie"]
        place = scratch(self.spark)
        # Where rows are equal in all columns, their place in the scan still deals them over ranges.
        ranges = min(MOST_RANGES, max(RANGES, -(-rows.count() // RANGE)))
        dealt = plain.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(ranges, *self.order, "uid")
        dealt.drop("uid").withColumn("bucket", F.spark_partition_id()).write.parquet(place)
        return self.spark.read.parquet(place)

    def _own(self, condition: Column | None) -> DataFrame:
        """Rows of the table that meet a condition on its own columns."""
        if condition is None:
            return self.ranged
        named = [F.col(o).alias(c) for c, o in zip(self.columns, self.own, strict=True)]
        extra = ("moment", "tie", "bucket")
        inner = {c: free(f"__{c}", self.columns) for c in extra}
        wide = self.ranged.select(*named, *[F.col(c).alias(inner[c]) for c in extra]).where(condition)
        return wide.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(self.columns, self.own, strict=True)], *[F.col(inner[c]).alias(c) for c in extra])

    def _placed(self, rows: DataFrame) -> DataFrame:
        hours = rows.where("moment is not null").groupBy(node(F.col("moment"), "hour").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
        tree = leaves(durable(hours), self.limit)
        return ranked(placed_in(rows, F.col("moment"), tree, "leaf"), self.limit, self.order)

    def _write(self, placed: DataFrame) -> None:
        """A file for each leaf and part: its rows are in one task, in order."""
        named = [F.col(o).alias(c) for c, o in zip(self.columns, self.own, strict=True)]
        at = F.translate("leaf", "/", "_")
        wide = placed.select("*", at.alias("d")).repartition("d", "part").sortWithinPartitions("d", "part", *self.order)
        wide.select(*named, F.col("d").alias(self.leaf_dir), F.col("part").alias(self.part_dir)).write.mode("append").option("maxRecordsPerFile", 0).partitionBy(self.leaf_dir, self.part_dir).parquet(self.folder)

    def _prints(self, rows: DataFrame, *by: str) -> DataFrame:
        """Number and sums of two hashes of the rows of each group: equal for equal rows, however often each recurs."""
        total = lambda h: F.sum(h.cast("decimal(38, 0)"))
        return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), total(F.col("tie")).alias("p"), total(F.col("tie2")).alias("q"))

    def files(self) -> DataFrame:
        """The rows on disk with ``leaf, part, path, at`` (place in the file) beside ``c0...``."""
        schema = StructType([*self.schema.fields, StructField(self.leaf_dir, StringType()), StructField(self.part_dir, LongType())])
        read = self.spark.read.schema(schema).parquet(self.folder)
        named = [F.col(f"`{c}`").alias(o) for c, o in zip(self.columns, self.own, strict=True)]
        return read.select(*named, F.translate(F.col(self.leaf_dir), "_", "/").alias("leaf"), F.col(self.part_dir).alias("part"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"))

    def _typed(self) -> list[tuple[str, str]]:
        return [(o, t) for o, (_, t) in zip(self.own, self.types, strict=True)]

    def _two(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("tie", _hash(self._typed())).withColumn("tie2", _hash(self._typed(), F.lit(1)))

    def manifest(self) -> DataFrame:
        """``path, leaf, part, n, p, q``: a row for each file there is, read from the files themselves."""
        return durable(self._prints(self._two(self.files()), "path", "leaf", "part"))

    def write(self, condition: Column | None = None) -> DataFrame:
        """Lay out the rows that meet ``condition`` (all, if none) and give the manifest of their files."""
        self._write(self._placed(self._own(condition)))
        return self.manifest()

    def rewrite(self, starting: DataFrame, condition: Column | None = None) -> None:
        """Lay out anew, over the files of ``starting``: those whose leaf, part and rows recur stay, the others go.

        New files are all written before the first one is removed. Removing is one call of the
        file system for each file that goes, by the driver.
        """
        place = scratch(self.spark)
        self._placed(self._own(condition)).write.parquet(place)
        placed = self.spark.read.parquet(place)
        wanted = self._prints(placed.withColumn("tie2", _hash(self._typed(), F.lit(1))), "leaf", "part")
        stays = durable(starting.join(wanted, ["leaf", "part", "n", "p", "q"]).groupBy("leaf", "part").agg(F.min("path").alias("path")))
        self._write(placed.join(stays.select("leaf", "part"), ["leaf", "part"], "left_anti"))
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for r in starting.join(stays, "path", "left_anti").select("path").toLocalIterator():
            old = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r["path"]))
            old.getFileSystem(conf).delete(old, False)

    def report(self, starting: DataFrame, key: str, new: Column) -> DataFrame:
        """A row for each file now: ``leaf, part, path, n_rows, columns, ids_sha256, n_new, rewritten``.

        ``ids_sha256`` is of the values of ``key`` in file order, decimal, joined by commas (a null one
        is empty text), streamed through one task a file; ``new`` tells rows of no starting file.
        """
        own = self.own[self.columns.index(key)]

        def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, state = None, None
            done = lambda: pd.DataFrame([[*now, state.hexdigest()]], columns=["leaf", "part", "ids_sha256"])
            for batch in batches:
                for file, ids in batch.groupby(["leaf", "part"], sort=False)["id"]:
                    joined = ",".join(ids.fillna("")).encode()
                    if file == now:
                        state.update(b"," + joined)
                        continue
                    if now is not None:
                        yield done()
                    now, state = file, sha256(joined)
            if now is not None:
                yield done()

        files = self.files()
        # A leaf and a part have one file, and are shorter to shuffle and sort than its path.
        ids = files.select("leaf", "part", "at", F.col(own).cast("string").alias("id")).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "at")
        digests = ids.mapInPandas(digest, "leaf string, part long, ids_sha256 string")
        named = files.select(*[F.col(o).alias(c) for c, o in zip(self.columns, self.own, strict=True)], *[F.col(c).alias(free(f"__{c}", self.columns)) for c in ("leaf", "part", "path")])
        by = [F.col(free(f"__{c}", self.columns)).alias(c) for c in ("leaf", "part", "path")]
        counts = named.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(new, 1).otherwise(0)).cast("long").alias("n_new"))
        old = starting.select("path", F.lit(False).alias("old"))
        out = counts.join(digests, ["leaf", "part"]).join(old, "path", "left")
        return out.select("leaf", "part", "path", "n_rows", F.lit(",".join(self.columns)).alias("columns"), "ids_sha256", "n_new", F.coalesce("old", F.lit(True)).alias("rewritten"))

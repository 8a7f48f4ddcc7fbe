"""What operators need of the session."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share.

    The session's ``spark.checkpoint.dir`` names it; only a local session without one gets a
    folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            import tempfile

            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="fiberloom-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the checkpoint folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new folder name within the shared one, for tables that are written and read again."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again.

    As :func:`durable`, but what is read has the size of its files: a checkpoint keeps the estimate of
    the plan it came from, which multiplies with every join, so loops that join their own results need this one.
    """
    place = scratch(df.sparkSession)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


#: Rows of one number that may be broadcast, some 30 MB as a hash table, of which the driver holds several forms at once.
BROADCAST_ROWS = 600_000


def _fields(schema: StructType) -> int:
    return sum(_fields(f.dataType) if isinstance(f.dataType, StructType) else 1 for f in schema)


def sent_rows(rows: DataFrame) -> int:
    """Rows that may be broadcast: fewer, the more fields they have."""
    return BROADCAST_ROWS * 2 // (1 + _fields(rows.schema))


def few(rows: DataFrame) -> DataFrame:
    """Rows of a few numbers each, broadcast if their count and fields show that they may be; else they are shuffled."""
    return F.broadcast(rows) if rows.count() <= sent_rows(rows) else rows


def among(rows: DataFrame, numbers: DataFrame, number: Column, *, anti: bool = False) -> DataFrame:
    """Rows whose whole ``number`` is in the one column of ``numbers`` (is not, if ``anti``), which is sent as bits.

    32,768 numbers that follow each other take 4 KB, so dense ones may be many; a null is among none.
    """
    of = F.col(f"`{numbers.columns[0]}`")
    # Numbers are shuffled, not the 4 KB of each bucket in each part of them.
    placed = numbers.where(of.isNotNull()).select(F.bitmap_bucket_number(of).alias("__fl_bucket"), F.bitmap_bit_position(of).alias("__fl_at")).repartition("__fl_bucket")
    bits = placed.groupBy("__fl_bucket").agg(F.bitmap_construct_agg("__fl_at").alias("__fl_bits"))
    place = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("__fl_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    has = F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")).cast("int"), F.lit(0)) == 1
    met = rows.join(F.broadcast(bits), F.bitmap_bucket_number(number) == F.col("__fl_bucket"), "left")
    return met.where(~has if anti else has).select(*[F.col(f"`{c}`") for c in rows.columns])


#: Rows of one key from which on it is hot; fewer than a hundred thousand keys can be.
HOT_KEY = 10_000


def skewed_join(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` of one row for each key, where a key may hold most of the rows.

    A table of at most :func:`sent_rows` is broadcast. Beyond that, by ``weight``, the number of rows of a key: keys beyond the greater of ``HOT_KEY`` and a
    hundred-thousandth of all weights are broadcast, and can't be more than a hundred thousand; the rest is shuffled.
    """
    count, total = table.agg(F.count(F.lit(1)), F.sum(weight)).first()
    if count <= sent_rows(table):
        return rows.join(F.broadcast(table), key)
    bound = max(HOT_KEY, total // 100_000)
    hot = table.where(F.col(weight) > bound)
    if hot.isEmpty():
        return rows.join(table, key)
    known = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(known, key, "left_anti").join(table.where(F.col(weight) <= bound), key))

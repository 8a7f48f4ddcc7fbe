"""Table toolkit: header cleanup, validation, keyed dedup, name matching, modes and pivots."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fiberloom.functions import kernel
from fiberloom.runtime import durable

REQUIRED = {
    "supervised": ("site_id", "site_name", "site_type", "lat", "long", "ring_name", "flag"),
    "unsupervised": ("site_id", "site_name", "lat", "long"),
    "polygon": ("site_id", "site_name", "long", "lat", "site_type"),
    "topology": ("site_id", "site_name", "long", "lat", "site_type"),
    "insert": ("site_id", "site_name", "long", "lat"),
    "update": ("name", "folders", "geometry"),
    "fwa": ("site_id", "long", "lat"),
}


def clean_names(names: list[str], lowercase: bool = False) -> list[str]:
    """Column names without line breaks, asterisks or what follows a dot; every repeated one is numbered from 1."""
    out = [re.sub(r"[\n\r*]", "", str(n)).split(".")[0].strip() for n in names]
    if lowercase:
        out = [re.sub(r"\W+", "_", n.lower()).strip("_") for n in out]
    seen: dict[str, int] = {}
    done = []
    for n in out:
        seen[n] = seen.get(n, 0) + 1
        done.append(f"{n}_{seen[n]}" if out.count(n) > 1 else n)
    return done


def sanitize_header(df: DataFrame, order: str | None = None, preview: int = 5, lowercase: bool = False) -> DataFrame:
    """Promote the first filled of the first rows where the header is missing, then clean names, rows and columns.

    ``order`` is the row-number column of a source that keeps one; without it no row is promoted.
    Rows and columns that hold nothing go, and so do columns whose name contains ``nan``.
    """
    names = [c for c in df.columns if c != order]
    if order and names and names[0].startswith("Unnamed"):
        for row in df.orderBy(order).limit(preview).collect():
            if any(row[c] is not None and str(row[c]).strip() for c in names):
                df = df.where(F.col(order) > row[order]).select(order, *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)])
                names = ["nan" if row[c] is None else str(row[c]) for c in names]
                break
    cols = [c for c in df.columns if c != order]
    keep = [(c, n) for c, n in zip(cols, clean_names(names, lowercase), strict=True) if "nan" not in n.lower()]
    if not keep:
        return df.select(*([order] if order else []))
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, (c, _) in enumerate(keep)]).first()
    keep = [p for i, p in enumerate(keep) if filled[i]]
    out = df.select(*([order] if order else []), *[F.col(f"`{c}`").alias(n) for c, n in keep])
    return out.dropna("all", subset=[n for _, n in keep]) if keep else out


def text(c: str | Column) -> Column:
    """Trimmed string, empty for null."""
    return F.coalesce(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")), F.lit(""))


def validate(df: DataFrame, kind: str, strings=("site_id", "site_name", "site_type", "ring_name", "flag", "region")) -> DataFrame:
    """Check the columns a job needs, make ids text, and keep rows with finite coordinates."""
    missing = [c for c in REQUIRED[kind] if c not in df.columns]
    if missing:
        raise ValueError(f"{kind}: missing columns {missing}")
    out = df.withColumns({c: text(c) for c in strings if c in df.columns})
    if "lat" in df.columns:
        out = out.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in ("lat", "long")}).where("lat between -90 and 90 and long between -180 and 180")
    return out


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first by ``order``; never an arbitrary one."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def split_sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Near and far end of a wide A/B table, by the suffix of its names; shared columns go to both."""
    def side(mark: str, other: str) -> DataFrame:
        cols = [c for c in df.columns if not c.lower().endswith(other)]
        return df.select(*[F.col(f"`{c}`").alias(c[: -len(mark)] if c.lower().endswith(mark) else c) for c in cols])

    return side("_a", "_b").withColumn("point_type", F.lit("NE")), side("_b", "_a").withColumn("point_type", F.lit("FE"))


def split_folders(folders: Column) -> dict[str, Column]:
    """Parts of a ``;`` joined folder path; null where the path is shorter."""
    parts = F.split(folders, ";")
    at = lambda i: F.trim(F.get(parts, F.lit(i)))
    last = lambda i: F.trim(F.try_element_at(parts, F.lit(-i)))
    return {"region": at(0), "ring": at(1), "site_type": last(1), "ring_last": last(2), "program": last(3)}


def region_code(folders: Column) -> Column:
    """Three to six capitals before a semicolon, null where there are none."""
    return F.nullif(F.regexp_extract(folders, "([A-Z]{3,6})\\s*;", 1), F.lit(""))


def next_version(name: Column) -> Column:
    n = F.nullif(F.regexp_extract(name, r"v(\d+)", 1), F.lit(""))
    return F.when(n.isNull(), "v1").otherwise(F.concat(F.lit("v"), (n.cast("int") + 1).cast("string")))


def iso_week(day: Column) -> Column:
    return F.weekofyear(F.to_date(day, "yyyyMMdd"))


def winkler_udf():
    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else kernel.jaro_winkler(p, q) for p, q in zip(a, b, strict=True)], dtype="float64")

    return similarity


def best_match(words: DataFrame, candidates: DataFrame, threshold: float = 0.6, block: int = 5_000) -> DataFrame:
    """``word, match, score``: the most similar candidate of at least ``threshold``, else the word itself with 0.

    ``candidates`` (columns ``ord``, ``name``) is a list of names such as column headers. It is
    dealt into blocks of about ``block`` names, and each distinct word meets every block once, so
    a list of any length is held in bounded pieces. The first of equals wins.
    """
    blocks = max(1, -(-candidates.count() // block))
    names = candidates.groupBy(F.pmod(F.xxhash64("name", "ord"), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("ord", "name"))).alias("names"))
    names = F.broadcast(names) if blocks <= 20 else names  # a hundred thousand names at most
    asked = words.select("word").distinct().withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    @F.pandas_udf("name string, score double, ord long")
    def closest(word: pd.Series, lists: pd.Series) -> pd.DataFrame:
        rows = []
        for w, known in zip(word, lists, strict=True):
            scored = [] if w is None else [(kernel.jaro_winkler(w, n["name"]), -n["ord"], n["name"]) for n in known if n["name"] is not None]
            s, at, name = max(scored, default=(None, None, None))
            rows.append((name, s, None if at is None else -at))
        return pd.DataFrame(rows, columns=["name", "score", "ord"])

    found = asked.join(names, "block", "left").where("names is not null").withColumn("b", closest("word", "names")).where("b.score is not null")
    best = found.groupBy("word").agg(F.max_by("b", F.struct("b.score", -F.col("b.ord"))).alias("b"))
    every = words.select("word").distinct().join(best.withColumnRenamed("word", "__w"), F.col("word").eqNullSafe(F.col("__w")), "left")
    good = F.coalesce(F.col("b.score") >= threshold, F.lit(False))
    return every.select("word", F.when(good, F.col("b.name")).otherwise(F.col("word")).alias("match"), F.when(good, F.col("b.score")).otherwise(0.0).alias("score"))


def numbered(df: DataFrame, order: list, name: str = "no") -> DataFrame:
    """Rows with their place from 1 in a global order, without bringing them into one task.

    Range partitions are in order; a row's place is its place within, after the rows of the
    partitions before. Only one count for each partition reaches the driver.
    """
    placed = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    before, total = {}, 0
    for r in sorted(placed.groupBy("__p").count().collect(), key=lambda r: r["__p"]):
        before[r["__p"]], total = total, total + r["count"]
    start = F.element_at(F.create_map(*[F.lit(v) for kv in before.items() for v in kv]), F.col("__p")) if before else F.lit(0)
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return placed.withColumn(name, (within + start).cast("long")).drop("__p")


def mode_of(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Most frequent value for each key, the least of equals, nulls left out."""
    n = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__n"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__n"), column))
    return n.withColumn("__r", best).where("__r = 1").select(*keys, column)


def pivot_sum(df: DataFrame, keys: list[str], column: str, values: list[str], amount: str) -> DataFrame:
    """Sum by the given values of a column, 0 where a key has none."""
    return df.groupBy(*keys).pivot(column, values).agg(F.sum(amount)).fillna(0, values)


def contained(texts: DataFrame, text: str, ids: DataFrame) -> DataFrame:
    """Pairs of a text and an id (``site_id``) that it contains.

    An equi-join on the pieces of a text that are as long as some id; only the few different
    lengths reach the driver.
    """
    lengths = sorted(r[0] for r in ids.select(F.length("site_id")).distinct().collect() if r[0])
    n = F.length(text)

    def pieces_of(k: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(k)))
        return F.when(n >= k, cut).otherwise(F.array().cast("array<string>"))  # a sequence up to a smaller number would count down

    pieces = [pieces_of(k) for k in lengths]
    if not pieces:
        return texts.select(text).join(ids.select("site_id"), F.lit(False))
    cut = texts.select(text).distinct().select(text, F.explode(F.array_distinct(F.concat(*pieces))).alias("site_id"))
    return cut.join(ids.select("site_id").distinct(), "site_id")


def near_far(segments: DataFrame, ids: DataFrame) -> DataFrame:
    """Near and far end of a segment name ``A-B``: the ids that its two parts contain.

    The words connection and route don't count, nor do dashes around the name. A part with several ids takes the least of those
    that are not the other side's; one without any has null. Every row of ``segments`` stays.
    """
    parts = F.split(F.btrim(F.regexp_replace("name", r"(?i)\b(connection|route)\b", ""), F.lit("- ")), "-")
    rows = segments.select("name").distinct().select("name", F.trim(F.get(parts, F.lit(0))).alias("p0"), F.trim(F.try_element_at(parts, F.lit(-1))).alias("p1"))

    def side(p: str) -> DataFrame:
        found = contained(rows, p, ids).groupBy(p).agg(F.sort_array(F.collect_set("site_id")).alias(f"ids_{p}"))
        return rows.join(found, p, "left").select("name", f"ids_{p}")

    both = side("p0").join(side("p1"), "name")
    empty = F.array().cast("array<string>")
    pick = lambda a, b: F.get(F.when(F.size(a) > 1, F.array_except(a, F.coalesce(b, empty))).otherwise(a), F.lit(0))
    ends = both.select("name", pick(F.col("ids_p0"), F.col("ids_p1")).alias("near_end"), pick(F.col("ids_p1"), F.col("ids_p0")).alias("far_end"))
    return segments.join(ends, "name", "left")

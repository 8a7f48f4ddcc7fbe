"""Line dedup with two Bloom filters: hashes met once, and hashes met twice.

Every task of the lines fills two filters and sends them on as compressed blocks of bits, which
merge by block: what two tasks both met once was met twice. Only lines that the second filter suspects
are shuffled. Those are confirmed by their SHA-256, counted by documents, and the document that keeps
the line is chosen. Documents that lose no line never move.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberloom.llm.common import fresh, let
from fiberloom.runtime import durable, scratch, skewed_join

#: Shortest key in code points, and documents that must hold it.
SHORTEST, DOCUMENTS = 20, 3
#: Bits for each line, and bits of a filter at most (64 MB): beyond some 10^8 lines more and more of
#: those met once are suspected too, and shuffle as 60 bytes each; the result is the same.
BITS_A_LINE, MOST_BITS = 8, 1 << 29
#: Bits set for each hash.
HASHES = 4
#: Bits of a block, which is a row while filters are merged, and hashes that a task holds before it sends them on.
BLOCK, HELD = 1 << 15, 1 << 20

SPACE = " \t\n\x0b\x0c\r"


def key_of(line: Column) -> Column:
    """The line without white space at its ends, ASCII letters in lower case."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, a row for each."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[None, :] + np.arange(HASHES, dtype=np.uint64)[:, None] * step[None, :]) & np.uint64(bits - 1)


def _blocks(hashes: np.ndarray, bits: int) -> dict[int, bytes]:
    at = np.unique(places(hashes, bits))
    edges = np.flatnonzero(np.diff(at // np.uint64(BLOCK))) + 1
    out = {}
    for part in np.split(at, edges) if len(at) else []:
        mask = np.zeros(BLOCK, np.uint8)
        mask[part % np.uint64(BLOCK)] = 1
        out[int(part[0]) // BLOCK] = np.packbits(mask, bitorder="little").tobytes()
    return out


@dataclass
class Filter:
    """Bits of what was met once, or twice; ``bits`` is a power of two."""

    bits: int
    data: np.ndarray

    def met(self, hashes: np.ndarray) -> np.ndarray:
        at = places(np.ascontiguousarray(hashes, np.int64), self.bits)
        return ((self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def filters(hashes: DataFrame, column: str, bits: int) -> DataFrame:
    """Blocks ``block, once, twice`` (compressed) of the filters of a column of longs.

    A task holds ``HELD`` hashes at a time, and merging streams through the rows of a block, so that
    neither grows with the input.
    """

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def sent(held: list[np.ndarray]) -> pd.DataFrame:
            met, times = np.unique(np.concatenate(held), return_counts=True)
            once, twice = _blocks(met, bits), _blocks(met[times > 1], bits)
            return pd.DataFrame({"block": list(once), "once": [zlib.compress(v, 1) for v in once.values()], "twice": [zlib.compress(twice[b], 1) if b in twice else None for b in once]})

        held, n = [], 0
        for batch in batches:
            held.append(batch[column].to_numpy(np.int64))
            n += len(held[-1])
            if n >= HELD:
                yield sent(held)
                held, n = [], 0
        if n:
            yield sent(held)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits_of = lambda v: np.frombuffer(zlib.decompress(v), np.uint8) if v is not None else np.zeros(BLOCK // 8, np.uint8)
        now, once, twice = None, None, None
        done = lambda: pd.DataFrame({"block": [now], "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})
        for batch in batches:
            for block, a, b in batch.itertuples(index=False):
                if block != now:
                    if now is not None:
                        yield done()
                    now, once, twice = block, bits_of(None), bits_of(None)
                a = bits_of(a)
                twice = twice | bits_of(b) | (once & a)
                once = once | a
        if now is not None:
            yield done()

    schema = "block int, once binary, twice binary"
    sent = hashes.select(column).where(F.col(column).isNotNull()).mapInPandas(fill, schema)
    return sent.repartition(max(1, min(200, bits // BLOCK)), "block").sortWithinPartitions("block").mapInPandas(merge, schema)


def gathered(blocks: DataFrame, which: str, bits: int) -> Filter:
    """One of the filters on the driver: ``bits`` / 8 bytes, ``MOST_BITS`` / 8 at most."""
    data = np.zeros(bits // 8, np.uint8)
    for r in blocks.select("block", which).collect():
        data[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(zlib.decompress(r[which]), np.uint8)
    return Filter(bits, data)


def bits_for(n: int) -> int:
    return min(MOST_BITS, max(BLOCK, 1 << (BITS_A_LINE * max(1, n) - 1).bit_length()))


def met(spark, known: Filter, column: str) -> Column:
    """Whether a column of longs may be in the filter, which is sent to each worker once."""
    sent = spark.sparkContext.broadcast(known)

    @F.pandas_udf("boolean")
    def may(hashes: pd.Series) -> pd.Series:
        return pd.Series(sent.value.met(hashes.to_numpy(np.int64)))

    return may(F.col(column))


def drops(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, documents: int = DOCUMENTS) -> DataFrame:
    """``id, text_hash, at``: positions of the lines, from 0, that each document loses; documents that lose none are absent."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(whole).alias("text_hash"), F.posexplode(F.split(whole, "\n")).alias("n", "line"))
    keys = lines.select("id", "text_hash", "n", key_of(F.col("line")).alias("key")).where(F.length("key") >= shortest)
    place = scratch(spark)
    keys.select("id", "text_hash", "n", F.xxhash64("key").alias("h"), F.unhex(F.sha2("key", 256)).alias("digest")).write.parquet(place)
    known = spark.read.parquet(place)
    bits = bits_for(known.count())
    suspects = known.where(met(spark, gathered(filters(known, "h", bits), "twice", bits), "h")).select("id", "text_hash", "n", "digest")
    # Equal lines of one document count once; a hot line's documents are dealt by themselves first.
    holders = suspects.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("lines"))
    repeated = holders.groupBy("digest").agg(F.count(F.lit(1)).alias("held"), F.max("id").alias("keeper"), F.sum("lines").alias("lines")).where(F.col("held") >= documents)
    lost = skewed_join(suspects, durable(repeated.select("digest", "keeper", "lines")), "digest", "lines").where(~F.col("id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("n")).alias("at"))


def without(lines: Column, at: Column) -> Column:
    """The array without the elements at the sorted positions: the stretches between them, put together."""
    gap = lambda x, d: lambda p, i: F.slice(x, F.coalesce(F.get(d, i - 1), F.lit(-1)) + 2, p - F.coalesce(F.get(d, i - 1), F.lit(-1)) - 1)
    ends = F.concat(at, F.array(F.size(lines)))
    return let(F.struct(lines.alias("x"), ends.alias("d")), lambda s: F.flatten(F.transform(s["d"], gap(s["x"], s["d"]))))


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, documents: int = DOCUMENTS) -> DataFrame:
    """Append ``n_lines`` and ``n_dropped`` (long) and ``kept``, the lines that stay, joined by line breaks.

    A line goes if its key has ``shortest`` code points and at least ``documents`` documents hold
    it, but in the largest ``doc_id`` among them. Rows of one id are one document; rows without an id
    are one document too, smaller than any other. A null or empty text is one empty line. Texts of any
    length are taken whole, equal lines of a document go or stay together. Every row, repeated ones too,
    gets its own; an empty table gives an empty one; input columns of the names appended are replaced.
    """
    spark = docs.sparkSession
    place = scratch(spark)
    drops(docs, doc_id=doc_id, text=text, shortest=shortest, documents=documents).write.parquet(place)
    lost = spark.read.parquet(place)
    names = ("n_lines", "n_dropped", "kept")
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    whole, key, own = F.coalesce(F.col(f"`{text}`"), F.lit("")), fresh("key"), fresh("id")
    rows = docs.withColumn(key, F.xxhash64(whole)).withColumn(own, F.xxhash64(F.col(f"`{doc_id}`"), key))
    # Which documents lose a line is a filter again, so that only those are joined.
    bits = bits_for(lost.count())
    ids = lost.select(F.xxhash64("id", "text_hash").alias("h"))
    losing = gathered(filters(ids, "h", bits), "once", bits)
    all_lines = F.size(F.split(whole, "\n")).cast("long")
    untouched = rows.where(~met(spark, losing, own)).select(*keep, all_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), whole.alias("kept"))
    at, theirs = fresh("at"), fresh("theirs")
    few = lost.select(F.col("id").alias(theirs), F.col("text_hash").alias(own + "t"), F.col("at").alias(at))
    joined = rows.where(met(spark, losing, own)).join(few, F.col(f"`{doc_id}`").eqNullSafe(F.col(theirs)) & (F.col(key) == F.col(own + "t")), "left")
    dropped = F.coalesce(F.size(at), F.lit(0)).cast("long")
    left = F.when(F.col(at).isNull(), whole).otherwise(F.array_join(without(F.split(whole, "\n"), F.col(at)), "\n"))
    return untouched.unionByName(joined.select(*keep, all_lines.alias("n_lines"), dropped.alias("n_dropped"), left.alias("kept")))

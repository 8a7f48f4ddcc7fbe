"""Not-modified revisits of a web archive, resolved to the responses they stand for.

A revisit record of a 304 answer has no body. It is joined as of its time to the latest earlier full
response of the same canonical URL; where the validators agree, the response's headers are updated
with those that a 304 may change, and the body is the response's.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fiberloom.llm.common import durable

#: Headers of a stored response that a 304 must not change (fixed by the HTTP caching standard).
FIXED_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")

RECORD = "record_id string, url string, ts timestamp, kind string, status int, headers map<string,string>, digest string, refers_to string, body binary"


def canonical(url: Column) -> Column:
    """Scheme and host in lower case; default port, fragment and empty query dropped; an empty path as ``/``.

    Dot segments of the path are removed, and the digits of percent-escapes are in upper case.
    """
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"\?$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    rest = F.substring(bare, F.length(head) + 1, F.length(bare))
    host = F.regexp_replace(head, r"^(http://[^/?]*):80$|^(https://[^/?]*):443$", "$1$2")
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    path, query = F.regexp_extract(rest, r"^[^?]*", 0), F.regexp_extract(rest, r"\?.*$", 0)
    # A segment of two dots takes the one before it away; one at the end leaves its slash.
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    parts = F.split(F.regexp_replace(path, r"(/\.\.?)$", "$1/"), "/")
    clean = F.concat(F.lit("/"), F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step), "/"))
    path = F.when(path.rlike(r"/\.\.?(/|$)"), clean).otherwise(path)
    joined = F.concat(host, path, query)
    pieces = F.split(joined, "%")
    raised = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), lambda x: F.concat(F.lit("%"), F.upper(F.substring(x, 1, 2)), F.substring(x, 3, F.length(x)))), ""))
    return F.when(head == "", bare).when(joined.contains("%"), raised).otherwise(joined)


def resolve(records: DataFrame, *, permitted_except=FIXED_HEADERS) -> DataFrame:
    """Per revisit: ``record_id, url, ts, status, response_id, response_ts, body_digest, headers``.

    ``records`` has the columns of ``RECORD`` without the body, which is found by ``response_id``.
    ``status`` is ``resolved``; ``mismatch`` where a validator that both hold differs (ETag, weak
    or strong; Last-Modified if no ETag is on both; the payload digest if neither is), or none is
    on both; ``orphan`` where no earlier full response exists; ``other`` for a revisit that is no
    304 answer (one of an identical digest has headers of its own). Only resolved rows have a response,
    a digest and merged headers. Of responses at one time the greatest record id counts as latest;
    a response at the revisit's own time is not earlier. Rows without a URL or time are orphans.
    Repeated rows each give a row. Extra columns don't matter; an empty table gives an empty one.

    The as-of join is cut by ranges of (URL, time), so that the captures of one URL, however many
    and however close in time, are dealt over many tasks: the last response of each range is
    carried forward over the ranges of its URL, and only captures of one range are ordered together.
    """
    lower = F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    rows = records.select("record_id", canonical(F.col("url")).alias("key"), "url", "ts", "kind", "status", lower.alias("headers"), "digest")
    known = F.col("key").isNotNull() & F.col("ts").isNotNull()
    full = (F.col("kind") == "response") & F.col("status").between(200, 299) & known
    revisit = F.col("kind") == "revisit"
    not_modified = F.coalesce(F.col("status") == 304, F.lit(False))
    what = F.struct("ts", "record_id", "digest", "headers")
    own = F.struct("url", "headers", "digest")
    cut = rows.where(full | revisit & known & not_modified).select("key", "ts", full.alias("full"), "record_id", F.when(full, what).alias("here"), F.when(~full, own).alias("ask"))
    # Equal rows are told apart, so that they can lie in several ranges.
    dealt = cut.withColumn("__fl_n", F.monotonically_increasing_id()).repartitionByRange("key", "ts", "full", "record_id", "__fl_n")
    dealt = durable(dealt.drop("__fl_n").withColumn("range", F.spark_partition_id()))

    # max_by compares (ts, record_id); maps have no order.
    last = dealt.groupBy("key", "range").agg(F.max_by("here", F.when(F.col("full"), F.struct("ts", "record_id"))).alias("last"))
    by_range = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("before", F.last("last", ignorenulls=True).over(by_range)).where("before is not null").select("key", "range", "before")
    # A URL lies in as many ranges as it fills, so few rows meet a range that is not its first.
    within = Window.partitionBy("key", "range").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.withColumn("here", F.last("here", ignorenulls=True).over(within)).where("not full")
    found = seen.join(carried, ["key", "range"], "left").select("ts", "record_id", "ask", F.coalesce("here", "before").alias("r"), F.lit(True).alias("asked"))
    lost = rows.where(revisit & ~(known & not_modified)).select("ts", "record_id", own.alias("ask"), F.lit(None).cast(found.schema["r"].dataType).alias("r"), not_modified.alias("asked"))
    found = found.unionByName(lost)
    weak = lambda tag: F.regexp_replace(tag, r"^W/", "")
    same = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), a == b)
    agrees = F.coalesce(
        same(weak(F.col("ask.headers")["etag"]), weak(F.col("r.headers")["etag"])),
        same(F.col("ask.headers")["last-modified"], F.col("r.headers")["last-modified"]),
        same(F.col("ask.digest"), F.col("r.digest")),
        F.lit(False),
    )
    status = F.when(~F.col("asked"), "other").when(F.col("r").isNull(), "orphan").when(agrees, "resolved").otherwise("mismatch")
    changes = F.map_filter("ask.headers", lambda k, v: ~k.isin(*permitted_except) & v.isNotNull())
    kept = F.map_filter("r.headers", lambda k, _: ~F.map_contains_key(changes, k))
    ok = F.col("status") == "resolved"
    return found.withColumn("status", status).select(
        "record_id",
        F.col("ask.url").alias("url"),
        "ts",
        "status",
        F.when(ok, F.col("r.record_id")).alias("response_id"),
        F.when(ok, F.col("r.ts")).alias("response_ts"),
        F.when(ok, F.col("r.digest")).alias("body_digest"),
        F.when(ok, F.map_concat(kept, changes)).alias("headers"),
    )


# files -----------------------------------------------------------------------------------------


def _headers(block: bytes, joined: bool = True) -> dict[str, str]:
    """Header fields by lower-cased name; equal names are joined by a comma, cookies by a line feed, or the first counts."""
    out: dict[str, str] = {}
    for line in block.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            continue
        name, value = name.decode("latin-1").strip().lower(), value.decode("utf-8", "replace").strip()
        if name not in out:
            out[name] = value
        elif joined:
            out[name] += ("\n" if name == "set-cookie" else ", ") + value
    return out


#: How a record begins.
VERSION = b"WARC/1."
#: Bytes that are read at once, and of a record's own header at most.
CHUNK, HEAD = 1 << 20, 1 << 20
#: Longest content that becomes a row.
LONGEST = 1 << 30


class Source:
    """A stream with a look ahead."""

    def __init__(self, stream):
        self.stream, self.left = stream, b""

    def fill(self, n: int) -> bool:
        """Whether ``n`` bytes are at hand."""
        while len(self.left) < n:
            more = self.stream.read(CHUNK)
            if not more:
                return False
            self.left += more
        return True

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer at the end."""
        got, size = [], 0
        while size < n:
            if not self.left:
                self.left = self.stream.read(min(CHUNK, n - size))
                if not self.left:
                    break
            got.append(self.left[: n - size])
            self.left = self.left[len(got[-1]) :]
            size += len(got[-1])
        return b"".join(got)

    def skip(self, n: int) -> int:
        """How many of the next ``n`` bytes there are."""
        size = 0
        while size < n and (got := len(self.take(min(CHUNK, n - size)))):
            size += got
        return size

    def seek_record(self) -> bool:
        """Pass over everything before the next line that begins a record."""
        first = True
        while True:
            if first and self.fill(len(VERSION)) and self.left.startswith(VERSION):
                return True
            at = self.left.find(b"\n" + VERSION)
            if at >= 0:
                self.left = self.left[at + 1 :]
                return True
            first, self.left = False, self.left[-len(VERSION) :]
            if not self.fill(len(self.left) + 1):
                return False

    def head(self) -> bytes | None:
        """A record's header, its blank line taken as well; None if it has no end within ``HEAD`` bytes."""
        while (at := self.left.find(b"\r\n\r\n", 0, HEAD)) < 0 and len(self.left) < HEAD:
            if not self.fill(len(self.left) + 1):
                break
        if at < 0:
            self.left = self.left[1:]
            return None
        out, self.left = self.left[:at], self.left[at + 4 :]
        return out


def records_of(stream, longest: int = LONGEST) -> Iterator[tuple]:
    """Rows of ``RECORD`` and ``fault`` of an archive, by the lengths that its records state.

    Other types of record are passed over. Whatever stands within a content never begins a record;
    only after a record without a sound length is the next line that begins one looked for.
    """
    source = Source(stream)
    while source.seek_record():
        head = source.head()
        if head is None:
            yield (None,) * 9 + ("no end of header",)
            continue
        named = _headers(head, joined=False)
        kind, length = named.get("warc-type", ""), named.get("content-length", "")
        sound = length.isascii() and length.isdigit()
        if kind not in ("response", "revisit"):
            if sound:
                source.skip(int(length))
            if not kind:
                yield (None,) * 9 + ("no type",)
            continue
        ts = pd.to_datetime(named.get("warc-date"), utc=True, errors="coerce")
        fault, content = None if sound else "bad length", b""
        if sound and int(length) > longest:
            fault = "too long" if source.skip(int(length)) == int(length) else "cut off"
        elif sound:
            content = source.take(int(length))
            if len(content) < int(length):
                fault, content = "cut off", b""
        http, _, body = content.partition(b"\r\n\r\n")
        status = http.split(b"\r\n", 1)[0].split()
        code = int(status[1]) if len(status) > 1 and status[1].isdigit() and len(status[1]) < 5 else None
        yield (named.get("warc-record-id"), named.get("warc-target-uri"), None if pd.isna(ts) else ts.tz_localize(None), kind, code, _headers(http), named.get("warc-payload-digest"), named.get("warc-refers-to"), body if kind == "response" and not fault else None, fault)


def read_warc(spark, path: str, longest: int = LONGEST) -> DataFrame:
    """Response and revisit records of the WARC files at ``path`` (plain or gzip, by their names), with a ``fault``.

    One task streams one file, record by record, each as long as its Content-Length says, so no
    archive is ever held whole and a body may hold whatever begins a record. Records of other types
    are passed over. A record that is malformed, cut off or above ``longest`` bytes (a row cannot hold more
    than 2 GB) keeps its row without a body; its ``fault`` tells what is wrong (null in sound records), and
    ``resolve`` finds no full response in it. Equal headers of one answer are joined (``_headers``).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")] + ["fault"]
        for batch in batches:
            for file in batch["path"]:
                system, place = FileSystem.from_uri(file)
                with system.open_input_stream(place, compression=None) as raw:
                    stream = gzip.GzipFile(fileobj=raw) if place.endswith(".gz") else raw
                    rows, size = [], 0
                    for row in records_of(stream, longest):
                        rows.append(row)
                        size += len(row[8] or b"")
                        if size > 16 * CHUNK or len(rows) == 100:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").load(path).select("path")  # the contents are not read here
    return files.repartition("path").mapInPandas(run, RECORD + ", fault string")

"""Quotation linking of messages, in DataFrame functions only.

Lines are parsed into quote levels; runs of one level are passages. The normalised passages (and
their lines) are hashed and joined to the own text (and lines) of earlier messages of the thread,
as of the quoting message; what no message of the thread holds is looked up among all threads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fiberloom.llm.common import durable, let
from fiberloom.runtime import few, skewed_join

MARKS = r"^\s{0,3}((?:>\s?)+)"


def normal(text: Column) -> Column:
    """Case, white space and surrounding punctuation don't matter to a quotation."""
    return F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "), F.lit(" .,;:!?\"'"))


def _key(text: Column) -> Column:
    n = normal(text)
    return F.when(n != "", F.unhex(F.md5(n)))


def _keys(text: Column) -> Column:
    """Hash of the whole text, then of its lines, each once; what is empty has none."""
    return F.array_distinct(F.filter(F.concat(F.array(_key(text)), F.transform(F.split(text, r"\n"), _key)), lambda k: k.isNotNull()))


def runs_of(body: Column) -> Column:
    """Runs of lines of one quote level, in order: ``run, level, lines``, marks taken off."""

    def parsed(raw: Column) -> Column:
        return let(F.regexp_extract(raw, MARKS, 0), lambda m: F.struct((F.length(m) - F.length(F.replace(m, F.lit(">"), F.lit("")))).alias("level"), F.substring(raw, F.length(m) + 1, F.length(raw)).alias("line")))

    def cut(rows: Column) -> Column:
        level = lambda i: F.get(rows, i - 1)["level"]
        starts = F.filter(F.sequence(F.lit(1), F.size(rows)), lambda i: (i == 1) | (level(i) != level(F.greatest(i - 1, F.lit(1)))))

        def runs(at: Column) -> Column:
            end = lambda k: F.coalesce(F.get(at, k + 1), F.size(rows) + 1)
            return F.transform(at, lambda i, k: F.struct(k.alias("run"), level(i).alias("level"), F.transform(F.slice(rows, i, end(k) - i), lambda x: x["line"]).alias("lines")))

        return let(starts, runs)

    return let(F.transform(F.split(body, r"\r?\n"), parsed), cut)


#: Positions of a thread that are ordered in one task at a time.
SPAN = 1_000


def link(messages: DataFrame, *, thread: str = "conv_id", pos: str = "turn", body: str = "text", author: str = "role", rounds: int = 40) -> DataFrame:
    """Per message: ``thread, pos, author, parent, source_thread, source_pos, depth, root, n_passages, n_linked, text``.

    ``text`` is the message without its quotes. ``parent`` is the latest earlier message of the
    thread that an outermost passage (level 1; the least level there is) quotes, whole or by a
    line; ``source_*`` is the earliest message of any other thread where the thread has none.
    ``depth`` counts the replies from ``root``; sorting by root, depth, pos puts every message after
    the one it answers. Bodies of any length are split whole. An empty table gives an empty one;
    other columns, also of these names, don't matter. A null body is empty. Positions that repeat within a thread are one
    message with its bodies in order of text; a null thread or position forms no link and keeps its row.
    """
    # One row for each position: repeated rows collapse before any join.
    of = lambda c: F.col(f"`{c}`")
    named = messages.select(of(thread).alias("thread"), of(pos).cast("long").alias("pos"), of(author).alias("author"), F.coalesce(of(body), F.lit("")).alias("body"))
    keyless = named.where("thread is null or pos is null")
    whole = named.where("thread is not null and pos is not null").groupBy("thread", "pos").agg(F.min("author").alias("author"), F.array_join(F.array_sort(F.collect_set("body")), "\n").alias("body"))
    # Quoted and own lines of each message, without an exchange.
    runs = whole.select("thread", "pos", "author", runs_of(F.col("body")).alias("runs"))
    text = F.btrim(F.array_join(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: F.array_join(r["lines"], "\n")), "\n"), F.lit(" \t\r\n"))
    whole = durable(runs.select("thread", "pos", "author", text.alias("text"), F.filter("runs", lambda r: r["level"] > 0).alias("quoted")))
    originals = whole.select("thread", "pos", F.explode(_keys(F.col("text"))).alias("key"))
    quoted = whole.select("thread", "pos", F.explode("quoted").alias("q")).select("thread", "pos", F.col("q.run").alias("run"), F.col("q.level").alias("level"), F.posexplode(_keys(F.array_join("q.lines", "\n"))).alias("nth", "key"))

    # As-of within (thread, key), a span of positions at a time: the latest earlier holder, without pairing holders and quotations.
    span = F.floor(F.col("pos") / SPAN).alias("span")
    none = lambda kind: F.lit(None).cast(kind)
    both = originals.select("thread", "key", span, "pos", none("int").alias("run"), none("int").alias("level"), none("int").alias("nth"), F.col("pos").alias("holder")).unionByName(quoted.withColumn("span", span).withColumn("holder", none("long")))
    before = Window.partitionBy("thread", "key", "span").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("parent", F.last("holder", ignorenulls=True).over(before)).where("level is not null")
    long = whole.where((F.col("pos") >= SPAN) | (F.col("pos") < 0)).select("thread").distinct()
    if not long.isEmpty():  # threads of several spans: the last holder of each is carried over the later ones
        ends = both.join(few(durable(long)), "thread", "left_semi").groupBy("thread", "key", "span").agg(F.max("holder").alias("last"))
        by_span = Window.partitionBy("thread", "key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("carried", F.last("last", ignorenulls=True).over(by_span)).where("carried is not null").select("thread", "key", "span", "carried")
        found = found.join(few(durable(carried)), ["thread", "key", "span"], "left").withColumn("parent", F.coalesce("parent", "carried"))
    linked = found.groupBy("thread", "pos", "run", "level").agg(F.min_by("parent", F.when(F.col("parent").isNotNull(), F.col("nth"))).alias("parent"), F.collect_list(F.struct("nth", "key")).alias("keys"))
    per_run = durable(linked.withColumn("keys", F.when(F.col("parent").isNull(), F.col("keys"))))

    # Elsewhere: two rows at most for each key, its earliest holder and the earliest of a different thread.
    lost = durable(per_run.where("parent is null").select("thread", "pos", "run", "level", F.explode("keys").alias("k")).select("thread", "pos", "run", "level", "k.nth", "k.key"))
    asked = durable(lost.groupBy("key").agg(F.count(F.lit(1)).alias("asks")))
    by_thread = originals.join(few(asked.select("key")), "key", "left_semi").groupBy("key", "thread").agg(F.min("pos").alias("at")).select("key", F.struct("thread", F.col("at").alias("pos")).alias("source"))
    by_thread = durable(by_thread)
    first = by_thread.groupBy("key").agg(F.min("source").alias("first"), F.count(F.lit(1)).alias("threads"))
    others = skewed_join(by_thread, first, "key", "threads").where("source.thread <> first.thread")
    second = others.groupBy("key").agg(F.min("source").alias("second"))
    holders = durable(first.drop("threads").join(second, "key", "left").join(asked, "key"))
    held = skewed_join(lost, holders, "key", "asks").withColumn("source", F.when(F.col("first.thread") != F.col("thread"), F.col("first")).otherwise(F.col("second"))).where("source is not null")
    runs_away = held.groupBy("thread", "pos", "run", "level").agg(F.min_by("source", "nth").alias("source"))
    away = runs_away.groupBy("thread", "pos").agg(F.min(F.struct("level", "source")).alias("s"), F.count_distinct("run").alias("n_away"))

    near = per_run.groupBy("thread", "pos").agg(
        F.count(F.lit(1)).alias("n_passages"),
        F.count("parent").alias("n_near"),
        F.min(F.when(F.col("parent").isNotNull(), F.struct("level", (-F.col("parent")).alias("less")))).alias("best"),
    )
    rows = whole.select("thread", "pos", "author", "text").join(near, ["thread", "pos"], "left").join(away, ["thread", "pos"], "left")
    rows = durable(rows.select("thread", "pos", "author", (-F.col("best.less")).alias("parent"), F.col("s.source.thread").alias("source_thread"), F.col("s.source.pos").alias("source_pos"), F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"), (F.coalesce("n_near", F.lit(0)) + F.coalesce("n_away", F.lit(0))).cast("long").alias("n_linked"), F.coalesce("text", F.lit("")).alias("text")))

    # Pointer doubling to the root, of those messages only that have not reached theirs.
    up = rows.select("thread", "pos", F.coalesce("parent", "pos").alias("root"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.col("parent").isNull().alias("done"))
    for _ in range(rounds):
        up = durable(up)
        open_ = up.where("not done")
        if open_.isEmpty():
            break
        above = up.select("thread", F.col("pos").alias("root"), F.col("root").alias("higher"), F.col("depth").alias("more"), F.col("done").alias("top"))
        moved = open_.join(above, ["thread", "root"]).select("thread", "pos", F.col("higher").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("top").alias("done"))
        up = up.where("done").unionByName(moved)
    out = rows.join(up.drop("done"), ["thread", "pos"]).select("thread", "pos", "author", "parent", "source_thread", "source_pos", "depth", "root", "n_passages", "n_linked", "text")
    alone = keyless.select("thread", "pos", "author", F.lit(None).cast("long").alias("parent"), F.lit(None).cast(out.schema["source_thread"].dataType).alias("source_thread"), F.lit(None).cast("long").alias("source_pos"), F.lit(0).cast("long").alias("depth"), F.col("pos").alias("root"), F.lit(0).cast("long").alias("n_passages"), F.lit(0).cast("long").alias("n_linked"), F.btrim(F.array_join(F.filter(F.split("body", r"\r?\n"), lambda x: ~x.rlike(MARKS)), "\n"), F.lit(" \t\r\n")).alias("text"))
    return out.unionByName(alone)

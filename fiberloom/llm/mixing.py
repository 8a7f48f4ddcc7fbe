"""Mixing sources to target token weights by entropy balancing.

Of all rates that take a source's target of tokens, and no document more than ``CAP`` times, the ones
of least divergence from 1 are exponentially tilted by a document's tokens: w = min(CAP, exp(lambda
* size)), one lambda for each source's constraint. Newton's iterations solve the convex dual: every
round sums the tokens taken and their slope over all documents of every source at once, which the
counts of equal sizes hold in full. Rates become whole copies with the running error carried along, largest
first, in small groups of documents that a hash deals out, so that no source is ever in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberloom.llm.common import WORD, durable
from fiberloom.runtime import skewed_join

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often.
CAP = 3
#: Documents that are rounded together; the running error stays below the least of their sizes.
GROUP = 64
#: Rounds of Newton's iteration at most; some ten suffice.
NEWTON_ROUNDS = 100


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Sources (one row each) with their position in code point order, null last, in ``at``.

    Range partitions are numbered in order; a row's place is the size of the partitions before its
    own plus its place within. Only one count for each partition reaches the driver.
    """
    from pyspark.sql.window import Window

    ordered = sources.withColumn("__fl_null", F.col("source").isNull())
    placed = durable(ordered.repartitionByRange("__fl_null", "source").sortWithinPartitions("__fl_null", "source").withColumn("__fl_part", F.spark_partition_id()))
    counts = {r["__fl_part"]: r["count"] for r in placed.groupBy("__fl_part").count().collect()}
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    within = F.row_number().over(Window.partitionBy("__fl_part").orderBy("__fl_null", "source"))
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]), F.col("__fl_part").cast("long")) if before else F.lit(0)
    return placed.withColumn("at", within + offset - 1).drop("__fl_part", "__fl_null")


def targets(sizes: DataFrame, *, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Token target of each source: its weight's share of all tokens, at most ``cap`` times its size.

    What capped sources leave is shared again by weight until none is above. Every round is one
    aggregation to two numbers; each caps one source more at least, and few are needed.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    table = durable(ranked(sizes).withColumn("weight", weight))
    total = table.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level = 0.0  # tokens for each unit of weight
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("source_size") * F.lit(float(cap))
        got = table.agg(F.sum(F.when(full, F.col("source_size") * cap)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not got["open"]:
            break
        new = (total - float(got["full"] or 0)) / got["open"]
        if new <= level * (1 + 1e-15):
            break
        level = new
    capped = F.col("source_size") * F.lit(float(cap))
    return table.withColumn("target", F.least(capped, F.col("weight") * F.lit(level)))


def exact(term: Column) -> Column:
    """A sum that does not depend on the order of its terms."""
    return F.sum(term.cast("decimal(38,9)")).cast("double")


def balanced(sizes: DataFrame, goal: DataFrame, *, cap: int = CAP, rounds: int = NEWTON_ROUNDS) -> DataFrame:
    """``goal`` (``source_key, source_size, target``) with ``lam``, the tilt by tokens; null where nothing is taken or all is, cap times.

    ``sizes`` has ``source_key, size, n``: how many documents of a source have a size. A round is
    one aggregation of two numbers for each source, T(l) = sum of n * size * min(cap, exp(l * x))
    and its slope, x the size by the source's mean. The step is Newton's on log T(l) = log target;
    one that leaves the bracket of the rounds before halves it instead.
    """
    means = sizes.where("size > 0").groupBy("source_key").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    solved = (F.col("target") <= 0) | (F.col("target") >= F.col("source_size") * F.lit(float(cap)))
    none = F.lit(None).cast("double")
    state = durable(goal.join(means, "source_key").withColumn("done", solved).withColumn("lam", F.when(~solved, F.lit(0.0))).withColumn("lo", none).withColumn("hi", none))
    for _ in range(rounds):
        left = state.where("not done")
        if left.isEmpty():
            break
        x = F.col("size") / F.col("mean")
        raised = F.exp(F.least(F.col("lam") * x, F.lit(math.log(cap) + 1.0)))
        tokens = F.col("n") * F.col("size").cast("double")
        sums = sizes.join(left.select("source_key", "lam", "mean"), "source_key").groupBy("source_key").agg(
            exact(tokens * F.least(raised, F.lit(float(cap)))).alias("t"), exact(F.when(raised < cap, tokens * x * raised).otherwise(0.0)).alias("slope")
        )
        met = state.join(sums, "source_key", "left")
        near = F.abs(F.col("t") - F.col("target")) <= F.lit(1e-12) * F.col("target")
        lo = F.when(F.col("t") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("t") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        met = met.withColumn("lo", F.when(F.col("done"), F.col("lo")).otherwise(lo)).withColumn("hi", F.when(F.col("done"), F.col("hi")).otherwise(hi))
        step = F.when(F.col("slope") > 0, F.log(F.col("target") / F.col("t")) * F.col("t") / F.col("slope"))
        newton = F.col("lam") + step
        inside = newton.isNotNull() & ~(newton <= F.col("lo")).eqNullSafe(True) & ~(newton >= F.col("hi")).eqNullSafe(True)
        halved = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), (F.col("lo") + F.col("hi")) / 2).when(F.col("hi").isNull(), 2 * F.col("lam") + 1).otherwise(2 * F.col("lam") - 1)
        new = F.when(inside, newton).otherwise(halved)
        over = F.col("done") | near | (new == F.col("lam"))
        state = durable(met.select("source_key", "source_size", "target", "mean", over.alias("done"), F.when(over, F.col("lam")).otherwise(new).alias("lam"), "lo", "hi"))
    return state.select("source_key", "source_size", "target", (F.col("lam") / F.col("mean")).alias("lam"))


def items(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per distinct ``doc_id, source, text_hash, size``: its ``n`` rows, and the ``copies`` taken of all of them together.

    With ``source_size, target, rate``. ``text_hash`` tells apart the texts that share an id, or have none.
    """
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), n_words(F.col(f"`{text}`")).alias("size"))
    rows = durable(named.groupBy("doc_id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    sizes = durable(rows.groupBy("source_key", "source", "size").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items")))
    sums = sizes.groupBy("source_key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("items").alias("items"))
    goal = durable(targets(sums, weights=weights, cap=cap))
    lams = balanced(sizes, goal.select("source_key", "source_size", "target"), cap=cap).select("source_key", "lam")
    goal = goal.join(lams, "source_key", "left").select("source_key", "source_size", "target", "lam", F.ceil(F.col("items") / GROUP).alias("__fl_groups"), F.col("items").alias("__fl_items"))
    joined = skewed_join(rows, durable(goal), "source_key", "__fl_items")
    full = F.col("target") >= F.col("source_size") * F.lit(float(cap))
    rate = F.when((F.col("size") == 0) | (F.col("target") <= 0), 0.0).when(full, F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size"), F.lit(math.log(cap) + 1.0)))))
    joined = joined.withColumn("rate", rate).withColumn("__fl_salt", F.pmod(F.xxhash64("doc_id", "text_hash", "size"), F.col("__fl_groups")))
    # Keyed to a hash of source and salt, a group of some GROUP distinct items; one source fills many groups.
    members = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("less"), "doc_id", "text_hash", "n", "rate")))
    groups = joined.groupBy("source_key", "__fl_salt").agg(members.alias("m"), F.first("source").alias("source"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))

    def one(acc, m):
        size = -m["less"].cast("double")
        due = acc["error"] + m["rate"] * size * m["n"]
        copies = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(cap)) * m["n"], F.floor(due / size + 0.5)))).otherwise(0.0)
        return F.struct((due - copies * size).alias("error"), F.concat(acc["out"], F.array(copies.cast("long"))).alias("out"))

    copies = F.aggregate("m", F.struct(F.lit(0.0).alias("error"), F.array().cast("array<bigint>").alias("out")), one, lambda acc: acc["out"])
    each = groups.withColumn("c", copies).select("source", "source_size", "target", F.explode(F.arrays_zip("m", "c")).alias("x"))
    return each.select(F.col("x.m.doc_id").alias("doc_id"), "source", F.col("x.m.text_hash").alias("text_hash"), (-F.col("x.m.less")).cast("long").alias("size"), F.col("x.m.n").alias("n"), F.col("x.c").alias("copies"), F.col("source_size").cast("long").alias("source_size"), "target", F.col("x.m.rate").alias("rate"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per row: ``doc_id, size, source, source_size, target, rate, copies, taken``.

    ``size`` counts the words of the whole text (0 for a null one), ``copies`` is how often the
    document is taken and ``taken`` = copies * size. A null source is a source of its own. Empty
    documents have nothing to take: 0 copies. Rows of one id, source and text share what is
    taken of them as evenly as whole copies allow; a null id is an id like any other. An empty
    table gives an empty one. Other columns of the input, also of these names, don't matter. Reruns
    agree, however the rows are dealt: groups come from a hash of id and text, and order within from size, id and text.
    """
    out = items(docs, doc_id=doc_id, text=text, source=source, weights=weights, cap=cap)
    step = 10_000  # rows that one array stands for at most
    out = out.withColumn("__fl_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step))))
    out = out.withColumn("__fl_r", F.explode(F.sequence(F.col("__fl_c") * step, F.least(F.col("n"), (F.col("__fl_c") + 1) * step) - 1)))
    each = (F.floor(F.col("copies") / F.col("n")) + F.when(F.col("__fl_r") < F.col("copies") % F.col("n"), 1).otherwise(0)).cast("int")
    out = out.withColumn("copies", each)
    return out.select("doc_id", "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))

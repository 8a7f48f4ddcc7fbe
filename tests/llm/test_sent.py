"""What the driver sends: fewer rows the more fields they have, and sets of rows as bits."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from fiberloom import runtime
from fiberloom.llm import jaccard


def hinted(df) -> bool:
    return "broadcast" in df._jdf.queryExecution().logical().toString().lower()


def test_rows_of_many_fields_count_more(spark, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 100)
    rows = spark.range(90)
    wide = rows.select("id", F.struct(F.col("id").alias("a"), F.col("id").alias("b"), F.col("id").alias("c")).alias("s"))
    assert hinted(runtime.few(rows)) and not hinted(runtime.few(wide)) and hinted(runtime.few(wide.limit(40)))


def test_among_is_exact(spark):
    rng = random.Random(5)
    known = [0, 1, 7, 8, 32767, 32768, 32769, (3 << 33) + 5, -1, -32768, -32769] + [rng.randrange(-(10**6), 10**6) for _ in range(300)]
    asked = known + [n + d for n in known for d in (-1, 1, 8)] + [None]
    rows = spark.createDataFrame([(n, str(n)) for n in asked], "n long, `a.b` string")
    numbers = spark.createDataFrame([(n,) for n in known] * 2 + [(None,)], "`c.d` long")
    for anti in (False, True):
        got = sorted(r["a.b"] for r in runtime.among(rows, numbers, F.col("n"), anti=anti).collect())
        assert got == sorted(str(n) for n in asked if (n in set(known)) != anti)
    assert runtime.among(rows, numbers.limit(0), F.col("n"), anti=True).count() == len(asked)


def test_near_duplicates_where_nothing_is_sent(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(40))
    some = [text() for _ in range(30)]
    rows = [(i if i % 11 else None, t) for i, t in enumerate(some + some[:12] + [t + " more" for t in some[5:20]] + [None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    seen = []
    for bound in (600_000, 1):
        monkeypatch.setattr(runtime, "BROADCAST_ROWS", bound)
        monkeypatch.setattr(jaccard, "SLOTS", 64 if bound > 1 else 1)
        kept = corpus_pipeline.first_of_near_duplicates(spark, docs, "").select("doc_id", "text")
        classes = jaccard.join(docs, words=5, percent=80).select("doc_id", "text_hash", "n_shingles", "component_id", "head")
        seen.append([sorted(map(str, df.collect())) for df in (kept, classes)])
    assert seen[0] == seen[1] and len(seen[0][0]) < len(rows)

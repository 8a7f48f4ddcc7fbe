"""The pipeline on a small corpus, stage by stage, against a plain version of each decision."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fiberloom.llm import mixing
from fiberloom.llm.queries import tokenizer_path

WORDS = [f"word{i}" for i in range(300)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(i, prose(60), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100, rows[3][1], "en", "s0"), (101, rows[3][1] + " tail", "en", "s1")]
    rows += [(200 + i, " ".join("##" + str(rng.randrange(5)) for _ in range(40)), "en", "s2") for i in range(20)]
    rows += [(300, prose(30) + " token = ad9b9ab81594e97f2d82ac69ac6544142c4f1d40 " + prose(10), None, None), (301, None, "en", "s0"), (302, "", "en", "s0"), (303, "short", "en", "s0")]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(200, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, corpus):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.durable(stage(spark, docs, corpus))
        assert docs.columns == columns, name
        seen[name] = docs
    ids = lambda name: sorted(r["doc_id"] for r in seen[name].collect())
    assert ids("quality rules") == [*range(40), 100, 101, 300]
    assert ids("n-gram Jaccard join") == [*range(40), 300]
    clean = {r["doc_id"]: r for r in seen["secret scan"].collect()}
    assert "ad9b9a" not in clean[300]["text"] and clean[300]["n_chars"] == len(clean[300]["text"])
    assert all(clean[i]["text"] == r["text"] for i, r in ((r["doc_id"], r) for r in seen["quality rules"].collect()) if i < 40)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(seen["secret scan"]).collect()}
    assert ids("source mix") == sorted(i for i, n in copies.items() for _ in range(n))
    library = Tokenizer.from_file(tokenizer_path())
    want = sorted((i, library.encode(clean[i]["text"], add_special_tokens=False).ids) for i, n in copies.items() for _ in range(n))
    out = corpus_pipeline.STAGES[-1][1](spark, seen["source mix"], corpus).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in out) == want


ODD = ["doc_id long", "text string", "lang string", "source string", "n_chars long", "`a.b` int", "size string", "kept string", "text_hash string", "rows int", "copies int"]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows whose ids are null or repeat, texts null, empty or equal, and columns that clash."""
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    a, b = prose(60), prose(60)
    rows = [(1, a), (1, a), (1, b), (None, b + " tail"), (None, prose(70)), (None, prose(70)), (2, None), (None, None), (3, ""), (4, prose(20_000)), (5, prose(50) + " password = Xk29dLw0qpZ8 end")]
    return spark.createDataFrame([(i, t, None if i == 2 else "en", None if i is None else f"s{i}", len(t or ""), 7, "x", "y", "z", 1, 1) for i, t in rows], ", ".join(ODD))


def test_stages_on_odd_rows(spark, corpus, odd):
    stage = dict(corpus_pipeline.STAGES)
    names = odd.columns
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    for name, run in corpus_pipeline.STAGES:
        empty = run(spark, odd.limit(0), corpus)
        assert empty.count() == 0
        assert name == "byte-pair encoding" or empty.columns == names
    given = pairs(odd)

    kept = stage["quality rules"](spark, odd, corpus)
    assert kept.columns == names and set(pairs(kept)) <= {p for p in given if p[1]}

    kept = pairs(stage["n-gram Jaccard join"](spark, odd, corpus))
    want = [p for p in given if p != (1, given[0][1])]
    texts = [t for _, t in kept]
    assert sum(i is None for i, _ in kept) == 3  # the near copy of 1's second text goes
    assert sum(i == 1 for i, _ in kept) == 2  # both of its texts, the first of them once
    assert len(kept) == len(given) - 2 and len(want) >= len(kept)
    assert texts.count(None) == 2

    clean = stage["secret scan"](spark, odd, corpus)
    assert clean.columns == names
    found = {r["doc_id"]: r for r in clean.where("doc_id in (4, 5)").collect()}
    assert "Xk29" not in found[5]["text"] and found[5]["n_chars"] == len(found[5]["text"])
    assert [p for p in pairs(clean) if p[0] != 5] == [p for p in given if p[0] != 5]

    mixed = stage["source mix"](spark, odd, corpus)
    assert mixed.columns == names
    taken = {}
    for r in mixing.items(odd).collect():
        taken[r["doc_id"], r["text_hash"]] = taken.get((r["doc_id"], r["text_hash"]), 0) + r["copies"]
    got = {}
    for r in mixed.select("doc_id", F.xxhash64("text").alias("h")).collect():
        got[r["doc_id"], r["h"]] = got.get((r["doc_id"], r["h"]), 0) + 1
    assert got == {k: n for k, n in taken.items() if n}
    assert None in {k[0] for k in got}

    ids = stage["byte-pair encoding"](spark, odd, corpus)
    assert ids.count() == odd.count()
    assert {r["n_tokens"] for r in ids.where("doc_id in (2, 3)").collect()} == {0}


def test_a_worker_gives_back_what_it_has_freed():
    from fiberloom.llm.common import give_back

    held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096  # noqa: E731, SIM115
    some = [bytes(1000) for _ in range(200_000)]
    pins = some[::5000]  # so that the heap's top stays in use
    before = held()
    del some
    give_back()
    assert before - held() > 100_000_000 and len(pins) == 40

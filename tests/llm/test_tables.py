"""Whitening, time partitions and line dedup against plain versions; nulls, empties, ties, repeats, clashing columns."""

import collections
import datetime as dt
import hashlib
import os
import random
import string

import numpy as np
from pyspark.sql import functions as F

from fiberloom.llm import linededup, timeparts, whitening
from fiberloom.runtime import scratch
from tests.llm.brute import time_parts

# op11 -------------------------------------------------------------------------------------------


def plain_whitening(x):
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    v = c.T @ c / n
    values, axes = np.linalg.eigh(v)
    return n, s, values[::-1], axes[:, ::-1], np.trace(v)


def test_whitening_equals_the_plain_form(spark):
    rng = np.random.default_rng(5)
    mixed = rng.standard_normal((300, 6)) @ rng.standard_normal((6, 6)) * [3, 2, 1, 1, 0.5, 9]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(mixed)] + [(7, mixed[7].tolist(), "again"), (None, mixed[3].tolist(), "no id")]
    bad = [(900, None, ""), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], ""), (902, [float("nan")] * 6, ""), (903, [float("inf")] * 6, ""), (904, [], ""), (905, [1e300] * 6, "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, whitened string")
    models = whitening.fit(df, components=4)
    got = whitening.whiten(df, models).collect()
    assert len(got) == len(rows) and set(models) == {6}
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    n, s, values, axes, trace = plain_whitening(x)
    assert models[6].n == n == 300 and models[6].sums == s.tolist()
    assert np.allclose(models[6].explained, values[:4] / trace, rtol=1e-9) and models[6].identity_error < 1e-9
    by_id = {r["vec_id"]: r for r in got}
    for i in (0, 7, 299):
        assert by_id[i]["deviation"] == int(((n * x[i] - s) ** 2).sum())
        want = (x[i] - s / n) @ axes[:, :4] / np.sqrt(values[:4])
        assert np.allclose(np.abs(by_id[i]["whitened"]), np.abs(want), atol=1e-8)


def test_whitening_of_few_and_of_several_lengths(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.fit(spark.createDataFrame([], schema)) == {}
    assert whitening.whiten(spark.createDataFrame([], schema), {}).count() == 0
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.0]), (4, [1.0]), (5, [4.0])]
    df = spark.createDataFrame(rows, schema)
    models = whitening.fit(df)
    assert models[2].n == 1 and models[2].components.shape == (2, 0) and models[1].n == 3
    got = {r["vec_id"]: r for r in whitening.whiten(df, models).collect()}
    assert got[1]["whitened"] == [] and got[1]["deviation"] == 0 and len(got[5]["whitened"]) == 1
    # Two dimensions that are one: the second component has no variance and is left out.
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], schema)
    assert len(whitening.fit(flat)[2].values) == 1
    # A deviation that no long holds.
    wide = spark.createDataFrame([(1, [1e13]), (2, [-1e13]), (3, [0.0])], schema.replace("float", "double"))
    assert whitening.whiten(wide, whitening.fit(wide)).where("vec_id = 1 and deviation is null").count() == 1


def test_pairs_in_several_aggregations(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7), 1.0 / (i + 1)]) for i in range(20)], "vec_id long, embedding array<double>")
    one = whitening.fit(df)[3]
    monkeypatch.setattr(whitening, "PAIRS", 2)
    assert np.allclose(whitening.fit(df)[3].values, one.values)


# op12 -------------------------------------------------------------------------------------------

SCHEMA = "click_id long, `at.t` timestamp_ntz, arrived_at timestamp_ntz, leaf string, moment string, m map<string,int>"
CUT = dt.datetime(2024, 4, 1)


def laid_out(spark, rows, limit):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    parts = timeparts.TimeParts(scratch(spark), df, F.col("`at.t`"), ["arrived_at", "click_id"], limit)
    early = F.coalesce(F.col("arrived_at") < F.lit(CUT), F.lit(False))
    starting = parts.write(early)
    parts.rewrite(starting)
    return parts, parts.report(starting, "click_id", ~early).collect()


def wanted(rows, limit):
    key = [(r[1], r[2], r[0]) for r in rows]
    first = time_parts([k for k in key if k[1] is not None and k[1] < CUT], limit)
    last = time_parts(key, limit)
    out = {}
    for at, held in last.items():
        ids = ",".join("" if k[2] is None else str(k[2]) for k in held)
        out[at] = (len(held), hashlib.sha256(ids.encode()).hexdigest(), sum(k[1] is None or k[1] >= CUT for k in held), first.get(at) != held)
    return out


def random_clicks(rng, n):
    rows = []
    for i in range(n):
        kind = rng.randrange(10)
        at = dt.datetime(2024, rng.randrange(1, 5), rng.randrange(1, 29), rng.randrange(24), rng.randrange(60))
        if kind < 3:
            at = dt.datetime(2024, 3, 5, 7)  # a hot hour
        elif kind == 3:
            at = dt.datetime(rng.randrange(1999, 2023), 1 + i % 12, 1)
        elif kind == 4 and i % 5 == 0:
            at = None
        arrived = None if i % 97 == 0 else dt.datetime(2024, 3, 1) + dt.timedelta(hours=rng.randrange(800) if kind < 6 else 0)
        rows.append((i, at, arrived, "x", "y", {"a": i}))
    return rows + rows[:20] + [(None, dt.datetime(2024, 2, 2), CUT, None, None, None)]


def test_time_parts_equal_the_plain_form(spark):
    rows = random_clicks(random.Random(3), 1500)
    for limit in (40, 5000):
        parts, got = laid_out(spark, rows, limit)
        want = wanted(rows, limit)
        assert {(r["leaf"], r["part"]): (r["n_rows"], r["ids_sha256"], r["n_new"], r["rewritten"]) for r in got} == want
        there = {os.path.join(d, f) for d, _, files in os.walk(parts.folder.removeprefix("file:")) for f in files if f.endswith(".parquet")}
        assert there == {r["path"].removeprefix("file://").removeprefix("file:") for r in got}
        assert {r["columns"] for r in got} == {"click_id,at.t,arrived_at,leaf,moment,m"}
    back = parts.files().select("c0", "c3", "c5").collect()
    assert len(back) == len(rows) and {r["c3"] for r in back} == {"x", None}


def test_time_parts_of_equal_rows_and_of_none(spark):
    same = [(1, dt.datetime(2024, 3, 5, 7), dt.datetime(2024, 3, 6), "x", "y", None)] * 100
    _, got = laid_out(spark, same, 30)
    assert sorted((r["leaf"], r["part"], r["n_rows"], r["rewritten"]) for r in got) == [("2024/03/05/07-07", p, n, False) for p, n in ((1, 30), (2, 30), (3, 30), (4, 10))]
    assert laid_out(spark, [], 1)[1] == []
    none = [(i, None, CUT, "x", "y", None) for i in range(5)]
    assert sorted((r["leaf"], r["part"], r["n_new"]) for r in laid_out(spark, none, 3)[1]) == [("null", 1, 3), ("null", 2, 2)]


def test_prefix_sums_of_bucket_counts(spark, monkeypatch):
    monkeypatch.setattr(timeparts, "SUMMED", 3)
    counts = spark.createDataFrame([(leaf, b, b + 1) for leaf in "ab" for b in range(0, 20, 1 + (leaf == "b"))], "leaf string, bucket int, n long")
    got = {(r["leaf"], r["bucket"]): r["before"] for r in timeparts._before(counts).collect()}
    assert got == {(leaf, b): sum(c + 1 for c in range(0, b, 1 + (leaf == "b"))) for leaf in "ab" for b in range(0, 20, 1 + (leaf == "b"))}


# op13 -------------------------------------------------------------------------------------------

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACE = " \t\n\x0b\x0c\r"


def plain_dedup(rows, shortest, documents):
    key = lambda line: line.strip(SPACE).translate(LOW)
    rank = lambda i: (i is not None, i or 0)
    held = collections.defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= shortest:
                held[key(line)].add(i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if len(held.get(key(line), ())) < documents or max(held[key(line)], key=rank) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_equals_the_plain_form(spark):
    rng = random.Random(4)
    pool = [f"  Line {i} with words of its own É{'x' * (i % 9)}" for i in range(40)] + ["short", "", "\x0b", "nur zwanzig Zeichen!!", "x" * 19, "x" * 20, "ÀBCDEFGHIJKLMNOPQRSTUV", "àBCDEFGHIJKLMNOPQRSTUV", " " + "y" * 20, "line 3 WITH words of its own Éxxx\t\r"]
    rows = [(rng.randrange(60), "\n".join(rng.choice(pool) + (str(rng.random()) if rng.random() < 0.5 else "") for _ in range(rng.randrange(12))), 1) for _ in range(150)]
    rows += [(None, pool[1], 2), (None, pool[2] + "\n" + pool[1], 2), (200, None, 3), (201, "", 4), (202, "\n\n", 4)] + rows[:3]
    rows += [(300, "\n".join(f"unique line number {i} of a long text" if i % 3 else pool[5] for i in range(30_000)), 5)]
    df = spark.createDataFrame(rows, "`d.i` long, text string, kept int")
    got = linededup.dedup(df, doc_id="d.i").select("`d.i`", "n_lines", "n_dropped", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_dedup(rows, 20, 3)
    other = linededup.dedup(df, doc_id="d.i", shortest=1, documents=2).select("`d.i`", "n_lines", "n_dropped", "kept").collect()
    assert sorted((tuple(r) for r in other), key=str) == plain_dedup(rows, 1, 2)
    assert linededup.dedup(df.limit(0), doc_id="d.i").count() == 0


def test_filters_miss_nothing_and_suspect_little(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HELD", 500)
    rng = np.random.default_rng(1)
    once = rng.integers(-(2**63), 2**63 - 1, 20_000)
    twice = rng.integers(-(2**63), 2**63 - 1, 3_000)
    df = spark.createDataFrame([(int(h),) for h in np.concatenate([once, twice, twice])], "h long").repartition(5)
    bits = linededup.bits_for(26_000)
    blocks = linededup.filters(df, "h", bits)
    first, second = linededup.gathered(blocks, "once", bits), linededup.gathered(blocks, "twice", bits)
    assert first.met(once).all() and first.met(twice).all() and second.met(twice).all()
    assert second.met(once).mean() < 0.05

"""Small cases of each corpus operator: nulls, empties, ties, repeats, clashing columns, brute force."""

import gzip
import hashlib
import random
import re
import time

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from fiberloom.llm import ann, bpe, html_text, jaccard, langid, mixing, quality, quotes, secrets, warc
from fiberloom.llm.queries import tokenizer_path

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "la", "mu"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# op8 --------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    texts = [None, "", "aaaa aaa  aa\n\n x", "<|endoftext|>a<|endoftext", "naïve 東京 👩‍👩‍👧 ՘ ½", "low lower lowest " * 3000, "x" * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2])]
    got = bpe.encode(docs(spark, rows).withColumn("ids", F.lit("clash")), tokenizer_path(), with_ids=True).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.encode(docs(spark, []), tokenizer_path()).count() == 0


# op5 --------------------------------------------------------------------------------------------


def test_secret_spans(spark):
    cases = {
        'token = "ad9b9ab81594e97f2d82ac69ac6544142c4f1d40" x': (1, 0, 1),
        "secret: token:abcdefghij": (0, 0, 0),
        "PassWord='short' AKIAABCDEFGHIJKL1 AKIASHORT": (0, 1, 0),
        "api_key=abc.def=ghi deadbeef": (1, 0, 0),
        "ſecret=abcdefghij toKen=abcdefghij": (0, 0, 0),
        "é token=abcdefgh": (1, 0, 0),
    }
    rows = [(i, t) for i, t in enumerate(cases)] + [(98, None), (99, "")]
    got = {r["doc_id"]: r for r in secrets.scan(docs(spark, rows).withColumn("spans", F.lit(1)), redact=True).collect()}
    for i, (text, counts) in enumerate(cases.items()):
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == counts, text
        base = []
        for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
            base += [(m.start(), 0, m.end(), "assign")] if len(m[2]) >= 8 else []
        base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(base))
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
    assert got[98]["redacted"] is None and got[99]["redacted"] == ""
    assert "ad9b" not in got[0]["redacted"]


def test_guess_cost_orders_values():
    cost = secrets.guess_cost
    assert cost("password") < cost("P@ssw0rd1999") < cost("x7Kp!9vQz")
    assert cost("aaaaaaaaaaaa") < cost("qwertyuiop") < cost("gk3vqzt81m")
    assert cost("20240131") < cost("83920147")
    assert cost("x7Kp!9vQ" * 5000 + "".join(map(chr, range(200, 5000))), 10.0) >= 10.0
    known = secrets.ranks(["correct", "horse", "battery", "staple"])
    assert cost("correcthorsebatterystaple", known=known) < 10 < cost("correcthorsebatterystaple")
    assert cost("abcabcabcabcabcabc") < 6


def _plain_cost(value, a, b, known):
    """Cost of one segment by its definition."""
    part, low, n = value[a:b], value[a:b].lower(), b - a
    costs = [secrets._brute(part)] if n == 1 else []
    plain = low.translate(secrets.PLAIN)
    form = low if low in known else plain
    if 3 <= n <= 24 and form in known:
        costs.append(secrets.SPLIT * (1 + (form != low) + (part != low)) + known[form])
    costs += [secrets.SPLIT + c for date, c in secrets.DATES if date.fullmatch(part)]
    for p in range(1, 13):
        if n % p == 0 and 2 <= n // p <= 64 and part == part[:p] * (n // p):
            costs.append(secrets.SPLIT + min(sum(map(secrets._brute, part[:p])), known.get(part[:p], np.inf)) + np.log10(n // p))
    if 3 <= n <= 24 and all(y in secrets.NEIGHBOURS.get(x, ()) for x, y in zip(low, low[1:], strict=False)):
        costs.append(secrets.SPLIT + np.log10(len(secrets.NEIGHBOURS)) + 0.5 * (n - 1))
    return min(costs, default=np.inf)


def test_guess_cost_equals_brute_force():
    rng, known = random.Random(8), secrets.ranks(["alpha", "beta", "stone", "one"])
    pieces = ["password", "Alpha", "bet@", "st0ne", "one", "2024", "20240131", "31-12-1999", "qwert", "zxc", "aaaa", "abab", "oneone", "x", "7", "!", "É", "K9", "19"]
    for _ in range(300):
        value = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6)))
        best = [0.0]
        for b in range(1, len(value) + 1):
            best.append(min(best[a] + _plain_cost(value, a, b, known) for a in range(b)))
        assert abs(secrets.guess_cost(value, known=known) - best[-1]) < 1e-9, value


def test_ranked_words(spark):
    rows = [(1, "Stone stone bird a the 12three"), (1, "Stone stone bird a the 12three"), (2, None), (3, ""), (4, "bird x" + "y" * 40), (None, "apple ärger")]
    table = docs(spark, rows).withColumn("word", F.lit("clash"))
    assert secrets.learn(table) == ["stone", "bird", "the", "three", "apple", "rger"]
    assert secrets.learn(table, keep=2) == ["stone", "bird"]
    assert secrets.learn(table.limit(0)) == []
    long = "pad " * 50_000 + "password = Zk38xQp0Lm72"
    got = secrets.scan(docs(spark, [(None, long), (None, long)]), words=["pad"]).collect()
    assert [r["spans"] for r in got] == [f"assign:200000:{len(long)},guess:200011:{len(long)}"] * 2
    assert secrets.scan(table.limit(0)).count() == 0


# op10 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>One  two.<br>three<p>Four <b>five</b>six</article><footer>f</footer></body></html>", "Title One two. three Four fivesix"),
        ('<body><div class="ad">Buy</div><div id="content"><p>Long enough paragraph of text, really.</p><p>Short.</p></div><div class="sidebar">x <a>y</a></div><section id="comments"><p>A reader says much, much more than that.</p></section>', "Long enough paragraph of text, really. Short."),
        ('<article><script>var t="</p>";</script><p>a &lt; b</p><!-- no --><form>f</form><p>cut <b', "a < b cut"),
        ("<article>" + "<div>" * 3000 + "deep text" + "</div>" * 3000, "deep text"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_extract_replaces_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>ä b</p>", "old"), (1, "u", "<p>ä b</p>", "old"), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).orderBy("page_id").collect()
    assert [(r["text"], r["n_chars"]) for r in got] == [("ä b", 3), ("ä b", 3), ("", 0)]


def test_core_equals_brute_force():
    """The formula by its definition, over every node of random small pages."""
    import math

    rng = random.Random(5)

    def tree(depth):
        kids = [tree(depth - 1) if depth and rng.random() < 0.6 else " ".join("x" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 4))]
        leaf = all(isinstance(k, str) for k in kids)  # a parser closes p and a around others
        return (rng.choice(["p", "a", "a", "div", "span"] if leaf else ["div", "section", "span"]), kids)

    def page(t):
        return t if isinstance(t, str) else f"<{t[0]}>" + "<!-- -->".join(map(page, t[1])) + f"</{t[0]}>"

    def counts(t, linked=False):
        """Characters, tags below, characters and tags of links."""
        if isinstance(t, str):
            return len(t), 0, len(t) * linked, 0
        below = [(counts(k, linked or t[0] == "a"), k) for k in t[1]]
        return sum(c[0] for c, _ in below), sum(c[1] + (not isinstance(k, str)) for c, k in below), sum(c[2] for c, _ in below), sum(c[3] + (not isinstance(k, str) and k[0] == "a") for c, k in below)

    def flat(t, linked=False):
        yield t, counts(t, linked or t[0] == "a")
        for k in t[1]:
            if not isinstance(k, str):
                yield from flat(k, linked or t[0] == "a")

    for _ in range(200):
        body = ("body", [tree(3) for _ in range(3)])
        whole = counts(body)
        share = whole[2] / max(whole[0], 1)

        def density(c):
            n, t, ln, lt = c
            base = math.log(n / max(n - ln, 1) * max(ln, 1) + share * n + math.e)  # noqa: B023
            return 0.0 if not n else n / max(t, 1) * max(0.0, math.log(n / max(ln, 1) * max(t, 1) / max(lt, 1), base))

        want = {}
        for t, c in flat(body):
            sums = sum(density(cc) for k in t[1] if not isinstance(k, str) for kk, cc in [next(x for x in flat(k, t[0] == "a"))])
            want.setdefault(round(sums, 6), []).append((c[0], t[0]))
        root = html_text.parse(page(body))
        nodes = html_text._nodes(next(x for x in html_text._nodes(root) if x.tag == "body"))
        html_text._measure(nodes, nodes[0])
        best = max(nodes, key=lambda x: (x.total, x.chars, -x.order))
        assert best.total == pytest.approx(max(want), abs=1e-5)
        assert (best.chars, best.tag) in [x for s, xs in want.items() if abs(s - max(want)) < 1e-5 for x in xs]


def test_pages_that_are_odd(spark):
    text = html_text.main_text
    assert text('<p title="the hidden truth">seen</p>') == "seen"
    assert text('<p data-id="footer">seen</p>') == "seen"
    assert text('<p>a <a href="/x?id=ad">link</a> b</p>') == "a link b"
    assert text("<p class=footer>gone</p><p>seen text here</p>") == "seen text here"
    assert text("<nav>| a | b</nav>|<div><p>Long enough paragraph text here</p></div>") == "| Long enough paragraph text here"
    assert text("<div>" * 50_000 + "</x>" * 50_000 + "deep") == "deep"
    assert len(text("<p>" + "word " * 200_000 + "</p>")) == 5 * 200_000 - 1
    assert text("<p>one two</p><p>one two</p>") == "one two one two"  # a tie
    body = "A paragraph with a good many words in it, and no link at all. " * 5
    shared = '<div class="share"><a href=a>Mail</a> <a href=b>Print</a> <a href=c>More</a></div>'
    assert text(f'<article><div class="header"><h1>Title</h1></div><p>{body}</p>{shared}<div class="related-note"><p>{body}</p></div></article>') == f"Title {body.strip()} {body.strip()}"
    assert text(f'<div class="site-header">Site</div><div><p>{body}</p></div>') == body.strip()
    assert text("İ<SCRIPT>x < y</SCRIPT>" + f"<p>{body}</p>") == f"İ {body.strip()}"
    for beside in ("commentlist", "adsbygoogle", "siteheader", "subnav", "cookiebanner", "disclaimer", "feedback", "reviews"):
        assert text(f'<main><div class="{beside}"><p>{body}</p></div><div><p>{body}</p><p>{body}</p></div></main>') == f"{body.strip()} {body.strip()}", beside
    for part in ("commentary", "navy", "postheader", "entrycontent", "adsorption", "socialist"):
        assert text(f'<main><div class="{part}"><p>{body}</p></div><div><p>{body}</p></div></main>') == f"{body.strip()} {body.strip()}", part
    links = "".join(f"<li><a href={i}>Go {i}</a></li>" for i in range(9))
    assert text(f"<body><main><div><p>{body}</p><p>{body}</p></div><ul>{links}</ul></main></body>") == f"{body.strip()} {body.strip()}"
    pages = spark.createDataFrame([(None, "u", "<p>a</p>"), (None, "u", "<p>a</p>")], "page_id long, url string, html string").withColumn("a.b", F.lit(1))
    assert [(r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()] == [("a", 1)] * 2
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("start, one", [("<p><td>", "<hr>"), ("<tr><div>", "<tbody></tbody>"), ("<p><td>", "<h1>"), ("<div>", "<td><tbody></tbody></tbody>"), ("<li><td>", "<li></li>")])
def test_searches_for_implied_ends_are_linear(start, one):
    took = []
    for n in (5_000, 40_000):
        began = time.perf_counter()
        assert html_text.parse(start + "<b>" * n + one * n).items
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * max(took[0], 0.01)  # eight times the page; quadratic would be 64 times


# op2 --------------------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(5)
    vocab = {"en": "the and with house water river stone".split(), "de": "der und mit haus wasser fluß stein".split()}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(30)), k) for i, k in enumerate(["en", "de"] * 20)]
    table = docs(spark, rows + [(100, None, "en"), (101, "text", None)], "doc_id long, text string, lang string")
    model = langid.fit(table)
    asked = docs(spark, [(1, "the river"), (2, "wasserstein"), (3, None), (4, "12 !?"), (5, "watery"), (6, "")]).withColumn("score", F.lit("x"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(asked, model).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["en", "de", "und", "und", "en", "und"]
    assert all(0 <= s <= 1 for _, s in got.values())
    empty = langid.fit(table.limit(0))
    assert {r["lang_pred"] for r in langid.predict(asked, empty).collect()} == {"und"}


@pytest.mark.parametrize("sent, grams, hot", [(None, None, 50_000), (40, None, 50_000), (40, 0, 50_000), (0, 0, 3)])
def test_language_equals_brute_force(spark, monkeypatch, sent, grams, hot):
    """The model sent whole, in part or not at all; rare words, marks and hot keys included."""
    monkeypatch.setattr(langid, "HOT", hot)
    rng = random.Random(6)
    vocab = {k: ["".join(rng.choice("aeionrstßé" if k == "de" else "aeionrstwh") for _ in range(rng.randrange(2, 7))) for _ in range(60)] for k in ("de", "en", "zz")}
    rows = [(i, " ".join(rng.choice(vocab[k]).title() for _ in range(rng.randrange(1, 40))) + " 1/2 ½x²y!", k) for i, k in enumerate(["de", "en", "zz"] * 15)]
    rows += [(90, "x" * 50, "long"), (91, "123 ½", "none"), (92, "हिन्दी में cafe\u0301", "hi"), rows[0], rows[0]]
    marked = lambda w: f"<{w}>"
    words = lambda t: regex.findall(r"\p{L}[\p{L}\p{M}]*", t.lower())
    cut = lambda w, n: [marked(w)[i : i + n] for i in range(len(w) + 3 - n)]
    langs, count = sorted({r[2] for r in rows}), {}
    for _, t, k in rows:
        for w in words(t):
            for n in range(5):
                for g in [w] if n == 0 else cut(w, n):
                    count[n, g, k] = count.get((n, g, k), 0) + 1
    total = {(n, k): sum(c for (m, _, x), c in count.items() if (m, x) == (n, k)) for n in range(5) for k in langs}
    gain = {(n, g, k): np.log(c / total[n, k]) - langid.FLOOR for (n, g, k), c in count.items()}
    of = lambda n, g: np.array([gain.get((n, g, k), 0.0) for k in langs])

    def vector(w):
        if of(0, w).any():
            return of(0, w)
        for n in range(4, 0, -1):
            found = [of(n, g) for g in cut(w, n) if of(n, g).any()]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(langs))

    asked = rows + [(200 + i, t, None) for i, t in enumerate(["½ ²³", "qqq qqq", "हिन्द cafe\u0301s", "\u0301", "Thon haßt", "x" * 50 + " on", " ".join(vocab["zz"] * 3000), "漢字"])]
    model = langid.fit(docs(spark, rows, "doc_id long, text string, lang string"), sent=sent, sent_grams=grams)
    got = langid.predict(docs(spark, asked, "doc_id long, text string, lang string"), model).collect()
    assert model[1].n_langs == len(langs) and model[1].whole == (sent is None) and len(got) == len(asked)
    for r in got:
        totals = sum((vector(w) for w in words(r["text"])), np.zeros(len(langs)))
        if not words(r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0), r
            continue
        assert abs(r["score"] - 1 / np.exp(totals - totals.max()).sum()) < 1e-6, r
        assert totals[langs.index(r["lang_pred"])] > totals.max() - 1e-6


def test_language_of_rare_words_and_ties(spark):
    rare = docs(spark, [(i, f"word{'abcdefghijklmnop'[i % 16]}{'abcdefghijklmnopqrs'[i // 16]}", "en") for i in range(300)], "doc_id long, text string, lang string")
    assert langid.fit(rare, sent=0)[1].langs == []
    many = docs(spark, [(i, "once only", "en" if i < 5_000 else "de") for i in range(10_000)] + [(10_000, "seldom", "de")], "doc_id long, text string, lang string")
    for sent in (None, 4, 0):  # a word seen once among 20,000 tells the language
        assert langid.predict(docs(spark, [(1, "seldom once")]), langid.fit(many, sent=sent, sent_grams=sent)).first()["lang_pred"] == "de"
    even = docs(spark, [(1, "same", "b"), (2, "same", "a")], "doc_id long, text string, lang string")
    got = langid.predict(even.limit(0).unionByName(even), langid.fit(even)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("a", 0.5)] * 2
    assert langid.predict(even.limit(0), langid.fit(even)).count() == 0


def test_language_words_are_dealt_once_and_buckets_find_hot_keys(spark, monkeypatch):
    plans, whole = [], langid._stored
    monkeypatch.setattr(langid, "_stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df))
    langid.fit(docs(spark, [(1, "same word", "b"), (2, "same", "a")], "doc_id long, text string, lang string"))
    assert plans[0].count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(langid, "HOT", 30)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"w{i}") for i in range(400)], "row long, word string")
    known = spark.createDataFrame([("hot", 1), ("w2", 2)], "word string, n int")
    got = langid._dealt_join(rows, known, ["word"], "left").collect()
    assert len(got) == 400 and sum(r["n"] or 0 for r in got) == 202 and {r["n"] for r in got if r["word"] == "hot"} == {1}


# op3 --------------------------------------------------------------------------------------------


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(1, 60)), None if s == 3 else f"s{s}") for i, s in enumerate(rng.choices(range(4), [60, 20, 8, 12], k=1500))]
    rows += [(9000, None, "s0"), (9001, "", "s1"), rows[0]]
    table = docs(spark, rows, "doc_id long, text string, source string")
    got = mixing.mix(table.withColumn("size", F.lit("clash"))).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(x for x in size if x is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, open_ = {}, set(order)
    while True:  # targets stop at three times the size, the excess is shared again
        rest = sum(size.values()) - sum(goal.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            goal |= share
            break
        goal |= {s: 3.0 * size[s] for s in over}
        open_ -= over
    for s in order:
        mine = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - goal[s]) < 1e-6 * goal[s] and r["source_size"] == size[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - goal[s]) <= 0.01 * goal[s] + 2
        # Rates are those of the one tilt that takes the target: bisection finds the same one.
        sizes = np.array([r["size"] for r in mine], float)
        taken = lambda lam: (sizes * np.minimum(3.0, np.exp(np.minimum(lam * sizes, 5)))).sum()  # noqa: B023, E731
        lo, hi = -50.0, 50.0
        for _ in range(200):
            lo, hi = ((lo + hi) / 2, hi) if taken((lo + hi) / 2) < goal[s] else (lo, (lo + hi) / 2)
        full = goal[s] >= 3 * size[s] * (1 - 1e-12)
        want = np.where(sizes == 0, 0.0, 3.0 if full else np.minimum(3.0, np.exp(np.minimum(lo * sizes, 5))))
        assert np.allclose([r["rate"] for r in mine], want, rtol=1e-6)
        assert all(abs(r["copies"] - r["rate"]) <= 3 for r in mine)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    key = lambda r: tuple(map(str, r))
    again = mixing.mix(table.repartition(7, "text")).collect()
    assert sorted(got, key=key) == sorted(again, key=key)
    assert mixing.mix(table.limit(0)).count() == 0


def test_mix_of_equal_ids(spark):
    text = "one two three four"
    rows = [(None, text, "a")] * 700 + [(7, text, "a")] * 300 + [(None, prose(random.Random(i), 4), "a") for i in range(200)] + [(1, text, "b")] * 40
    got = mixing.mix(docs(spark, rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 900
    for s in "ab":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 4
    equal = [r["copies"] for r in got if r["doc_id"] == 7]
    assert max(equal) - min(equal) <= 1


# op6 --------------------------------------------------------------------------------------------


def _rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_rules_and_ratio(spark):
    rng = random.Random(4)
    good = [(i, prose(rng, 80)) for i in range(30)]
    junk = [(100 + i, " ".join("###" + str(rng.randrange(9)) + "|" for _ in range(60))) for i in range(20)]
    passage = prose(rng, 12)
    odd = [(200, None), (201, ""), (202, " \t\n"), (203, "x"), (204, f"{passage} {prose(rng, 30)} {passage}"), (205, "a\nb\na\n\n \n" * 9), (206, passage * 40), (207, "one two three four five six seven"), good[0]]
    rows = good + junk + odd
    table = docs(spark, rows).withColumn("llr", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(100, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(table, quality.fit(table, labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert _rules(r["text"]) == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])
    assert all(r["kept"] for r in got if r["doc_id"] < 100)
    assert not any(r["kept"] for r in got if 100 <= r["doc_id"] < 200)
    unlabelled = quality.judge(table, quality.fit(table, labels.limit(0))).collect()
    assert all(r["llr"] == 0 for r in unlabelled)


def test_quality_ratio_equals_plain_version(spark):
    import math
    from collections import Counter

    import xxhash

    word = lambda w: xxhash.xxh64_intdigest(w.encode(), seed=42)
    pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), seed=xxhash.xxh64_intdigest(a.to_bytes(8, "little"), seed=42))

    def buckets(t):
        h = [word(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        return [g % quality.BUCKETS for g in (*h, *map(pair, h, h[1:]))]  # a power of two, so signs don't matter

    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["Alpha", "béta", "γ", "d.", "##"][: 3 + i % 3]) for _ in range(rng.randrange(0, 60)))) for i in range(40)]
    rows += [(None, "Alpha " * 5000), (None, None), rows[1], rows[1]]
    trusted = {i for i in range(40) if i % 3 == 0}
    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(buckets(t))
        good.update(buckets(t) if i in trusted else ())
    share = sum(good.values()) / sum(raw.values())
    ratio = {g: math.log((good[g] + quality.PRIOR) / (c * share + quality.PRIOR)) for g, c in raw.items()}
    labels = spark.createDataFrame([(i, int(i in trusted), 0) for i in range(40)] + [(3, 1, 0), (99, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    table = docs(spark, rows)
    for r in quality.judge(table.withColumn("a.b", F.lit(1)), quality.fit(table, labels)).collect():
        found = buckets(r["text"])
        llr = sum(ratio[g] for g in found) / max(1, len(found))
        assert abs(r["llr"] - llr) < 1e-9
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality.THRESHOLD)
    assert quality.judge(table.limit(0), quality.fit(table.limit(0), labels)).count() == 0


# op9 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(1)
    fresh = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    for n in [*range(1, 60), 100, 300, 1000]:
        for _ in range(10):
            a = np.unique(fresh(n))
            d = int(rng.integers(0, n * (100 - percent) // percent + 2))
            x = int(rng.integers(0, d + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[: max(1, len(a) - x)], fresh(d - x)]))
            same = len(np.intersect1d(a, b))
            if not jaccard.linked(np.array([same]), len(a), np.array([len(b)]), percent)[0] or same == max(len(a), len(b)):
                continue
            either = np.union1d(a, b)
            either = either[rng.random(len(either)) < 0.5]
            own = jaccard.band_of(len(a), percent)
            for choice in (None, int(rng.integers(6))):  # any allocation, any tokens that are frequent
                plans = choice and {k: (jaccard.choices(k, percent) * 6)[choice] for k in range(max(0, own - 2), own + 3)}
                for frequent in (jaccard.NONE_FREQUENT, jaccard.Frequent(either, rng.integers(3, 90, len(either)), 50)):
                    assert len(np.intersect1d(jaccard.signatures(a, percent, plans, frequent), jaccard.signatures(b, percent, plans, frequent)))


def brute_components(rows, words, percent):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split(" ")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", " ".join(w)) if x]
        return {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}

    sets = [(i, shingles(t)) for i, t in rows]
    comp = {i: i for i, _ in rows}
    for _ in rows:
        for a, s in sets:
            for b, t in sets:
                if s and t and 100 * len(s & t) >= percent * len(s | t) and comp[a] != comp[b]:
                    low, high = sorted((comp[a], comp[b]))
                    comp = {k: low if v == high else v for k, v in comp.items()}
        break
    return {i: (len(s), comp[i]) for i, s in sets}


@pytest.mark.parametrize(("words", "percent", "hot"), [(4, 85, 20_000), (5, 80, 20_000), (5, 80, 4)])
def test_join_equals_brute_force(spark, monkeypatch, words, percent, hot):
    monkeypatch.setattr(jaccard, "BLOCK", 8)  # many blocks a cluster
    monkeypatch.setattr(jaccard, "HOT", hot)  # buckets that are chained
    rng = random.Random(9)
    rows = []
    for base in range(6):
        text = prose(rng, 90).split()
        for _ in range(14):
            t = list(text)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = "new" + str(rng.randrange(999))
            rows.append((len(rows) * 7 % 1009, " ".join(t)))
    passage = prose(rng, 40)
    rows += [(3000 + i, f"{prose(rng, 8)} {passage}") for i in range(12)] + [(3100 + i, rows[i][1]) for i in range(0, 40, 3)]
    rows += [(2000, None), (2001, ""), (2002, "Same Short"), (2003, "same\tshort"), (2004, "one"), (2005, rows[0][1].upper()), (2006, prose(rng, 4000))]
    got = jaccard.join(docs(spark, rows).withColumn("n", F.lit(1)).withColumn("a.b", F.lit(1)).repartition(3), words=words, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, words, percent)
    assert len(got) == len(rows) and all(r["head"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_join_of_repeated_and_null_ids(spark):
    rng = random.Random(2)
    a, b, c = prose(rng, 50), prose(rng, 50), prose(rng, 50)
    rows = [(1, a), (1, a), (1, b), (2, b + " x"), (None, a), (None, c), (None, c), (None, None), (2, None)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["head"]) for r in jaccard.join(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 46, 1, True), (1, 46, 1, False), (1, 46, 1, True), (2, 47, 1, False), (None, 46, 1, False), (None, 46, None, True), (None, 46, None, False), (None, 0, None, True), (2, 0, 2, True)], key=str)
    assert jaccard.join(docs(spark, []), words=4, percent=85).count() == 0


# op7 --------------------------------------------------------------------------------------------


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 16))
    x[200:260] = x[7]  # a vector that is very common
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(table.withColumn("part", F.lit(1)), table.where("vec_id % 50 = 0"), part=32, probe_share=1.0).collect()
    hit = 0
    for q in range(0, 400, 50):
        score = ann.cosine(x, np.broadcast_to(x[q], x.shape))
        best = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - score[r["vec_id"]]) < 1e-15 for r in mine)
        hit += len({r["vec_id"] for r in mine} & set(best))
        if q == 200:
            assert [r["vec_id"] for r in mine] == [7, 201, 202, 203, 204]
    assert hit >= 0.95 * 40
    assert ann.search(table.limit(0), table.limit(0)).count() == 0


def test_nearest_at_its_defaults(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20_000, 64))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = ann.search(table, table.where("vec_id % 50 = 0")).collect()
    scaled = x / np.linalg.norm(x, axis=1, keepdims=True)
    near, hit = scaled[::50] @ scaled.T, 0
    near[np.arange(400), np.arange(0, 20_000, 50)] = -2
    for q, best in zip(range(0, 20_000, 50), np.argsort(-near, axis=1)[:, :5], strict=True):
        hit += len({r["vec_id"] for r in got if r["query_id"] == q} & set(best.tolist()))
    assert len(got) == 2000 and hit >= 0.9 * 2000


def test_nearest_of_odd_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1.0, 0.0]), (3, [1.0, 2.0, 3.0]), (50, [2.0, 4.0, 6.0]), (4, [3.0, 2.0, 1.0]), (50, [9.0, 9.0]), (5, [1.0, 0.0]), (None, [1.0, 0.0]), (100, [0.0, 0.0]), (6, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("a.b", F.lit(1))
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.search(table, table.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 50, 1.0), (0, 3, 2, 0.707107), (0, 4, 5, 0.707107), (50, 1, 3, 1.0), (50, 2, 4, 0.714286)]


# op1 --------------------------------------------------------------------------------------------


def test_revisits(spark, tmp_path):
    t = lambda s: f"2024-01-0{s}"
    rows = [
        ("r1", "http://A.com:80/x#f", t("1 00:00:00"), "response", 200, {"ETag": '"1"', "Content-Type": "text/html", "Age": "9"}, "d1"),
        ("r2", "http://a.com/x", t("3 00:00:00"), "response", 200, {"ETag": '"2"'}, "d2"),
        ("r3", "http://a.com/x", t("3 00:00:00"), "response", 404, {"ETag": '"3"'}, "d3"),
        ("v1", "http://a.com/x", t("1 00:00:00"), "revisit", 304, {"etag": '"1"'}, "d1"),
        ("v2", "http://a.com/x", t("2 00:00:00"), "revisit", 304, {"etag": 'W/"1"', "Content-Type": "no", "Cache-Control": "max-age=1"}, "d1"),
        ("v3", "http://a.com/x", t("4 00:00:00"), "revisit", 304, {"etag": '"1"'}, "d1"),
        ("v4", "http://a.com/x", t("4 00:00:00"), "revisit", 304, None, "d2"),
        ("v5", None, t("4 00:00:00"), "revisit", 304, None, "d2"),
        ("v6", "http://a.com/x", None, "revisit", 304, None, "d2"),
    ]
    table = spark.createDataFrame(rows, "record_id string, url string, ts string, kind string, status int, headers map<string,string>, digest string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["record_id"]: r for r in warc.resolve(table.withColumn("day", F.lit(1))).collect()}
    assert {k: (r["status"], r["response_id"]) for k, r in got.items()} == {"v1": ("orphan", None), "v2": ("resolved", "r1"), "v3": ("mismatch", None), "v4": ("resolved", "r2"), "v5": ("orphan", None), "v6": ("orphan", None)}
    assert got["v2"]["headers"] == {"etag": 'W/"1"', "content-type": "text/html", "age": "9", "cache-control": "max-age=1"}
    assert warc.resolve(table.limit(0)).count() == 0
    again = table.unionByName(table)
    assert warc.resolve(again).count() == 12 and {(r["record_id"], r["status"]) for r in warc.resolve(again).collect()} == {(k, r["status"]) for k, r in got.items()}
    record = lambda kind, http: (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://a.com/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Record-ID: <{kind}>\r\nContent-Length: {len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n")
    content = record("response", b"HTTP/1.1 200 OK\r\nETag: x\r\n\r\nbody\xff\r\n\r\n") + record("request", b"GET /") + record("revisit", b"HTTP/1.1 304 Not Modified\r\nETag: x\r\n\r\n")
    broken = record("response", b"HTTP/1.1 200 OK\r\n\r\nx").replace(b"Length: 20", b"Length: many") + record("response", b"HTTP/1.1 200 OK\r\n\r\nwhole")[:-9]
    (tmp_path / "a.warc").write_bytes(content + broken)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(content[:300]) + gzip.compress(content[300:]))
    read = warc.read_warc(spark, str(tmp_path)).collect()
    sound = [r for r in read if r["fault"] is None]
    assert sorted(r["kind"] for r in sound) == ["response"] * 2 + ["revisit"] * 2
    assert {bytes(r["body"]) for r in sound if r["kind"] == "response"} == {b"body\xff\r\n\r\n"}
    assert {(r["status"], tuple(r["headers"].items())) for r in sound if r["kind"] == "revisit"} == {(304, (("etag", "x"),))}
    assert sorted(r["fault"] for r in read if r["fault"]) == ["bad length", "cut off"]
    assert warc.resolve(warc.read_warc(spark, str(tmp_path))).count() == 2


def test_archives_by_length(spark, tmp_path):
    def record(kind, http, name):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n"

    inner = record("response", b"HTTP/1.1 200 OK\r\n\r\nnot a record", "inner")
    http = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1, b\r\nVary: x\r\nset-cookie: c=2\r\nvary: y\r\n\r\n"
    large = b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)) * 20_000
    content = record("warcinfo", inner, "i") + record("response", http + b"\r\n\r\n" + inner + b"end", "a") + record("response", large, "b") + record("", b"x", "c") + record("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", "d")
    (tmp_path / "x.warc").write_bytes(content)
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(content[:700]) + gzip.compress(content[700:]))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(str(r["record_id"]) for r in got) == ["<a>"] * 2 + ["<b>"] * 2 + ["<d>"] * 2 + ["None"] * 2
    for r in got:
        if r["record_id"] == "<a>":
            assert bytes(r["body"]) == b"\r\n\r\n" + inner + b"end" and r["fault"] is None
            assert r["headers"] == {"set-cookie": "a=1, b\nc=2", "vary": "x, y"}
        elif r["record_id"] == "<b>":
            assert bytes(r["body"]) == bytes(range(256)) * 20_000
        elif r["record_id"] is None:
            assert r["fault"] == "no type"
    short = {r["record_id"]: (r["body"], r["fault"]) for r in warc.read_warc(spark, str(tmp_path / "x.warc"), longest=1_000_000).collect()}
    assert short["<b>"] == (None, "too long") and short["<a>"][1] is None


def test_archive_of_a_record_above_any_row():
    class Stream:
        """A response of 3 GB, then a revisit."""

        def __init__(self):
            head = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3000000000\r\n\r\n"
            self.parts, self.zeros = [head, b"\r\n\r\nWARC/1.0\r\nWARC-Type: revisit\r\nContent-Length: 0\r\n\r\n"], 3_000_000_000

        def read(self, n):
            if len(self.parts) == 1 and self.zeros:
                n = min(n, self.zeros)
                self.zeros -= n
                return bytes(n)
            return self.parts.pop(0) if self.parts else b""

    assert [(r[3], r[9]) for r in warc.records_of(Stream())] == [("response", "too long"), ("revisit", None)]


def test_revisits_equal_brute_force(spark):
    rng = random.Random(12)
    rows = [(f"{rng.choice('rv')}{i}", rng.choice(["http://hot/", "http://b/"]), 1_700_000_000 + rng.randrange(40), None, rng.choice([200, 200, 404]), {"etag": str(rng.randrange(2))}, None) for i in range(400)]
    rows = [(*r[:3], "response" if r[0][0] == "r" else "revisit", r[4] if r[0][0] == "r" else rng.choice([304, 304, 200]), *r[5:]) for r in rows]
    table = spark.createDataFrame(rows, "record_id string, url string, ts long, kind string, status int, headers map<string,string>, digest string").withColumn("ts", F.timestamp_seconds("ts"))
    got = {r["record_id"]: (r["status"], r["response_id"]) for r in warc.resolve(table.repartition(5)).collect()}
    for v in rows:
        if v[3] == "revisit":
            before = [r for r in rows if r[3] == "response" and r[4] == 200 and r[1] == v[1] and r[2] < v[2]]
            last = max(before, key=lambda r: (r[2], r[0]), default=None)
            want = ("other", None) if v[4] != 304 else ("orphan", None) if last is None else ("resolved", last[0]) if last[5] == v[5] else ("mismatch", None)
            assert got.pop(v[0]) == want
    assert not got


def test_canonical_urls(spark):
    urls = {"HTTP://A.com:80": "http://a.com/", "https://a.com:443/x?": "https://a.com/x", "http://a.com/a/./b/../c/..": "http://a.com/a/", "http://a.com/%c3%a9?q=%2f": "http://a.com/%C3%A9?q=%2F", "http://a.com/../x": "http://a.com/x", "http://a.com/x?a=/../b": "http://a.com/x?a=/../b", "mailto:x#y": "mailto:x", "http://a.com/a//b": "http://a.com/a//b"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", warc.canonical(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in got} == urls


# op4 --------------------------------------------------------------------------------------------


def test_quotations(spark):
    rows = [
        (1, 0, "u", "Hello there.\nHow are you?"),
        (1, 1, "a", "> Hello there.\n> how ARE you\nFine."),
        (1, 2, "u", "> Fine.\n>> How are you?\nGood."),
        (1, 3, "a", "> How are you?\nStill fine."),
        (2, 0, "u", "> Still fine\nQuoting another thread"),
        (2, 1, "u", None),
        (2, 1, "u", None),
        (None, 0, "u", "> q\nown"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash"))
    got = {(r["thread"], r["pos"]): r for r in quotes.link(table).collect()}
    assert {k: (r["parent"], r["depth"], r["root"], r["text"]) for k, r in got.items() if k[0]} == {
        (1, 0): (None, 0, 0, "Hello there.\nHow are you?"),
        (1, 1): (0, 1, 0, "Fine."),
        (1, 2): (1, 2, 0, "Good."),
        (1, 3): (0, 1, 0, "Still fine."),
        (2, 0): (None, 0, 0, "Quoting another thread"),
        (2, 1): (None, 0, 1, ""),
    }
    assert (got[2, 0]["source_thread"], got[2, 0]["source_pos"]) == (1, 3)
    assert got[None, 0]["text"] == "own" and got[1, 2]["n_linked"] == 2
    assert quotes.link(table.limit(0)).count() == 0


def test_quotations_across_threads(spark):
    rows = [
        (1, 0, "u", "First line.\nSecond line.\nThird line."),
        (2, 0, "u", "> Second line\n> Third line\nPart of another thread's message."),
        (3, 0, "u", "> no one wrote this\n> second line\nOnly one line is known."),
        (4, 0, "u", "Shared words"),
        (4, 1, "u", "> Alone here\nx"),
        (5, 0, "u", "> Shared words\nno"),
        (5, 1, "u", "Shared words"),
        (3, 1, "u", "> Later words\nLater words"),
        (6, 0, "u", "Later words"),
        (4, 2, "u", "> Nobody anywhere\ny"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["thread"], r["pos"]): (r["parent"], r["source_thread"], r["source_pos"], r["n_linked"]) for r in quotes.link(table).collect()}
    assert got[2, 0] == (None, 1, 0, 1)
    assert got[3, 0] == (None, 1, 0, 1)
    assert got[5, 0] == (None, 4, 0, 1)
    assert got[3, 1] == (None, 6, 0, 1)
    assert got[4, 1] == got[4, 2] == (None, None, None, 0)


def test_quotations_of_long_threads(spark, monkeypatch):
    """As-of over several spans of positions equals one span; quoted by a plain version."""
    rng = random.Random(10)
    words = ["Yes.", "No.", "See you there", "Fine by me", "Line\nand line"]
    rows, said = [], {}
    for thread in (1, 2):
        for pos in sorted(rng.sample(range(-20, 300), 120)):
            own = rng.choice(words)
            quote = rng.choice(words)
            rows.append((thread, pos, "u", "> " + quote.replace("\n", "\n> ") + "\n" + own))
            said.setdefault((thread, own), []).append(pos)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for span in (1_000, 7):
        monkeypatch.setattr(quotes, "SPAN", span)
        got = {(r["thread"], r["pos"]): r["parent"] for r in quotes.link(table).collect()}
        for thread, pos, _, text in rows:
            quote = text.rpartition("\n")[0] if not text.endswith("and line") else text[: -len("\nLine\nand line")]
            quote = quote.replace("> ", "")
            before = [p for p in said.get((thread, quote), []) if p < pos]
            assert got[thread, pos] == max(before, default=None)

"""Language identification by known words first, shorter and shorter character n-grams otherwise.

A known word scores by its log frequency in each language. A word that no language knows backs off
to its character n-grams, from ``MAX_GRAM`` down to 1, and takes the longest order of which any
gram is known. Counts cover every learning row, and whatever was counted once is known: the model is a
table of words and one of n-grams, of any size. If they have few rows, all is sent to the
executors and texts are scored where they lie. Beyond that only the most frequent words are sent; the
other words of the texts are joined to the table. 64-bit hashes stand for n-grams throughout. Gains are
whole numbers, so that all ways give the same sums in any order.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberloom.llm.common import durable, let
from fiberloom.runtime import scratch

#: A letter and the letters and marks after it.
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LETTER, MARK = regex.compile(r"\p{L}"), regex.compile(r"\p{M}")
#: Distinct other characters of a text from which on it is cut by the pattern.
OTHERS = 100
MAX_GRAM = 4
#: Log frequency of what a language lacks though another one has it, or half a count of the largest language if that is less.
FLOOR = math.log(1e-7)
#: Gains are counted in parts of this.
UNIT = 1 << 32
#: Rows of words, and as many of n-grams, of 20 bytes each, that are sent to the executors, and languages that their arrays may have.
SENT, DENSE = 1_000_000, 1_000
#: Rows of one key from which on a join deals it over several tasks.
HOT = 50_000
UNKNOWN = "und"


MULTIPLIER = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray, order: int) -> np.ndarray:
    """Finalizer of splitmix64, apart for words (0) and each order of n-grams."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((order + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


class Marked:
    """Words between marks, as one array of code points; 64-bit hashes stand for words and n-grams."""

    def __init__(self, words: list[str]):
        text = "".join([f"<{w}>" for w in words])
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(self.codes)) - np.repeat(self.starts, self.sizes)

    def words(self) -> np.ndarray:
        if not len(self.sizes):
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(self.sizes.max()) - 1, MULTIPLIER, np.uint64)]))
            return _mixed(np.add.reduceat(self.codes * power[self.place], self.starts), 0)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each n-gram, and the number of its word, in order."""
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        at = np.flatnonzero(self.place + n <= self.sizes[owner])
        with np.errstate(over="ignore"):
            h, power = np.zeros(len(at), np.uint64), np.uint64(1)
            for j in range(n):
                h += self.codes[at + j] * power
                power *= np.uint64(MULTIPLIER)
        return _mixed(h, n), owner[at]


@dataclass
class Model:
    """What is sent of a model, by hash, in order, and the table of all of it.

    Entry i has the languages ``lang[start[i]:start[i + 1]]``, and in ``gain`` how much more
    frequent than the floor it is in each. ``whole`` tells that nothing but these is known;
    else they are words. ``first`` and ``n_langs`` are of all learned languages.
    """

    langs: list[str]
    keys: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    whole: bool
    n_langs: int
    first: str | None

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashes, at, -1)

    def rows(self, entries: np.ndarray) -> np.ndarray:
        """Gains of some entries, a column for each language."""
        out = np.zeros((len(entries), len(self.langs)), np.int64)
        n = self.start[entries + 1] - self.start[entries]
        at = np.repeat(self.start[entries] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[np.repeat(np.arange(len(entries)), n), self.lang[at]] = self.gain[at]
        return out

    def vectors(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Vector of each word, its own where it is known, else the mean of its longest n-grams that any is known of; and whether it is not told by what was sent."""
        out = np.zeros((len(words), len(self.langs)), np.int64)
        at = self.find(Marked(words).words())
        out[at >= 0] = self.rows(at[at >= 0])
        if not self.whole:
            return out, at < 0
        left = np.flatnonzero(at < 0)
        out[left] = self.backed_off([words[i] for i in left])
        return out, np.zeros(len(words), bool)

    def backed_off(self, words: list[str]) -> np.ndarray:
        """Vector of each unknown word, where all n-grams were sent."""
        out, left = np.zeros((len(words), len(self.langs)), np.int64), np.arange(len(words))
        for n in range(MAX_GRAM, 0, -1):
            if not len(left):
                break
            hashes, owner = Marked([words[i] for i in left]).grams(n)
            at = self.find(hashes)
            at, owner = at[at >= 0], owner[at >= 0]
            if len(at):
                firsts = np.flatnonzero(np.diff(owner, prepend=-1))
                count = np.diff(np.append(firsts, len(owner)))
                out[left[owner[firsts]]] = np.add.reduceat(self.rows(at), firsts, axis=0) // count[:, None]
                left = np.delete(left, owner[firsts])
        return out


_kinds: dict[str, int] = {}  # 0 for a letter, 1 for a mark, 2 for others; as many as there are characters


def _kind(c: str) -> int:
    return _kinds.setdefault(c, 0 if LETTER.match(c) else 1 if MARK.match(c) else 2)


def words_of_text(text: str) -> list[str]:
    """Lower-cased words: a letter and the letters and marks after it.

    Where a text has no marks, blanks in place of all that is no letter part its words; the pattern would take several times as long.
    """
    text = text.lower()
    kinds = {c: _kinds[c] if c in _kinds else _kind(c) for c in set(text)}
    others = [c for c, kind in kinds.items() if kind == 2 and c != " "]
    if 1 in kinds.values() or len(others) > OTHERS:
        return WORDS.findall(text)
    for c in others:
        text = text.replace(c, " ")
    return text.split()


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Word counts of a partition, emptied whenever they grow large; each language has the empty word, counted 0 times."""
    counts: dict[str, Counter] = {}

    def flush() -> Iterator[pd.DataFrame]:
        for lang, words in counts.items():
            words[""] = 0
            yield pd.DataFrame({"lang": [lang] * len(words), "word": list(words), "n": list(words.values())})
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            counts.setdefault(lang, Counter()).update(words_of_text(text))
        if sum(map(len, counts.values())) > 200_000:
            yield from flush()
    yield from flush()


def _pieces(words: list[str], size: int = 1_000_000) -> Iterator[slice]:
    """Slices of so many code points or of one word."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
    a = 0
    while a < len(words):
        b = max(a + 1, int(np.searchsorted(ends, size + (ends[a - 1] if a else 0), "right")))
        yield slice(a, b)
        a = b


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the hashed n-grams of distinct words, by order, some 200,000 words at a time."""
    held: list[pd.DataFrame] = []

    def flush() -> Iterator[pd.DataFrame]:
        if not held:
            return
        for lang, part in pd.concat(held).groupby("lang", sort=False):
            words, weights = part["word"].tolist(), part["n"].to_numpy(np.int64)
            for piece in _pieces(words):
                marked, w = Marked(words[piece]), weights[piece]
                for k in range(1, MAX_GRAM + 1):
                    h, owner = marked.grams(k)
                    codes, keys = pd.factorize(h)
                    if len(keys):
                        sums = np.zeros(len(keys), np.int64)
                        np.add.at(sums, codes, w[owner])
                        yield pd.DataFrame({"lang": lang, "k": np.int32(k), "h": keys.view(np.int64), "n": sums})
        held.clear()

    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= 200_000:
            yield from flush()
            size = 0
    yield from flush()


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words by hash."""
    for batch in batches:
        words = batch["word"].tolist()
        for piece in _pieces(words):
            yield batch.iloc[piece].assign(h=Marked(words[piece]).words().view(np.int64))[["h", "lang", "gain"]]


def _stored(df: DataFrame) -> DataFrame:
    """Written in columns to the folder that all executors share, and read again: a fifth of what a checkpoint takes."""
    place = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


class Known(NamedTuple):
    """All of a model: ``word, of`` of the words that were not sent, with a count ``n`` of each language; ``lang, k, h, n`` of the n-grams; ``k, lang, total, floor``."""

    words: DataFrame
    grams: DataFrame
    totals: DataFrame

    def gains(self, rows: DataFrame) -> DataFrame:
        """``gain`` of rows with ``k, lang, n``, in place of ``n``."""
        gain = F.round((F.log(F.col("n") / F.col("total")) - F.col("floor")) * UNIT).cast("long")
        return rows.join(self.totals, ["k", "lang"]).withColumn("gain", gain).drop("n", "total", "floor")


def _sent(part: DataFrame | None, langs: list[str], whole: bool, n_langs: int, first: str | None) -> Model:
    """Rows ``h, lang, gain``, of bounded number, as arrays on the driver."""
    if part is None:
        none = np.zeros(0, np.int64)
        return Model([], none.view(np.uint64), np.zeros(1, np.int64), none, none, whole, n_langs, first)
    place = (F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int")
    found = part.select("h", place.alias("lang"), "gain").toArrow()
    keys, place, gains = (found[c].to_numpy() for c in ("h", "lang", "gain"))
    del found
    keys = keys.view(np.uint64)
    order = np.lexsort((place, keys))
    keys = keys[order]
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return Model(langs, keys[start], np.append(start, len(keys)), place[order], gains[order], whole, n_langs, first)


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", sent: int | None = None, sent_grams: int | None = None) -> tuple[Known, Model, Model | None]:
    """Learn from every row with a text and a language, whole texts of any length.

    Gives the tables of all words and n-grams, and what is sent
    of them: all, if words have up to ``sent`` rows and n-grams up to ``sent_grams`` (``SENT``), and there are up to
    ``DENSE`` languages; else the words of the highest counts that have as many, and apart from them the n-grams if all fit. None of
    either with more languages. What is predicted does not depend on it. The counts are
    aggregated over all rows, combined on the map side. Languages are those of all learning rows,
    also where nothing of one is known; without rows there are none. Repeated rows count each time.
    """
    sent, sent_grams = SENT if sent is None else sent, SENT if sent_grams is None else sent_grams
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null and text is not null")
    # Dealt by word once: both sums are found where its rows lie.
    counted = rows.mapInPandas(_count_words, "lang string, word string, n long").repartition("word").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = _stored(counted.groupBy("word").agg(F.sum("n").alias("sum"), F.collect_list(F.struct("lang", "n")).alias("of")))
    n_langs, first = counted.where("word = ''").select(F.explode("of.lang").alias("lang")).agg(F.count(F.lit(1)), F.min("lang")).first()
    words = counted.where("word != ''").withColumn("class", F.floor(F.log2("sum") * 8))
    by_lang = words.select("word", "class", F.lit(0).alias("k"), F.explode("of").alias("x")).select("word", "class", "k", "x.lang", "x.n")
    grams = _stored(by_lang.select("lang", "word", "n").mapInPandas(_count_grams, "lang string, k int, h long, n long").groupBy("lang", "k", "h").agg(F.sum("n").alias("n")))
    totals = by_lang.select("lang", "k", "n").unionByName(grams.drop("h")).groupBy("lang", "k").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    totals = _stored(totals)
    floors = totals.groupBy("k").agg(F.least(F.lit(FLOOR), F.log(0.5 / F.max("total"))).alias("floor"), F.sum("rows").alias("rows"))
    sizes = {r["k"]: r["rows"] for r in floors.select("k", "rows").collect()}  # one row an order
    totals = totals.drop("rows").join(F.broadcast(floors.drop("rows")), "k")
    known = Known(words.select("word", "of"), grams, F.broadcast(totals) if n_langs <= DENSE else totals)
    if n_langs > DENSE:
        return known, _sent(None, [], False, n_langs, first), None
    langs = sorted(r["lang"] for r in totals.select("lang").distinct().collect())  # DENSE at most
    grams_fit = sum(x for k, x in sizes.items() if k) <= sent_grams
    hashes = "h long, lang string, gain long"
    gram_gains = known.gains(grams).select("h", "lang", "gain")
    if grams_fit and sizes.get(0, 0) <= sent:
        head = known.gains(by_lang).select("word", "lang", "gain").mapInPandas(_hashed, hashes).unionByName(gram_gains)
        return known, _sent(head if langs else None, langs, True, n_langs, first), None
    # Words by the logarithm of their count, a few hundred classes: as many of the upper ones as may be sent.
    classes = sorted(((r["class"], r["rows"]) for r in words.groupBy("class").agg(F.sum(F.size("of")).alias("rows")).collect()), reverse=True)
    fitting = [c for i, (c, _) in enumerate(classes) if sum(x for _, x in classes[: i + 1]) <= sent]
    head = None
    if fitting:
        head = known.gains(by_lang.where(F.col("class") >= fitting[-1])).select("word", "lang", "gain").mapInPandas(_hashed, hashes)
        known = known._replace(words=words.where(F.col("class") < fitting[-1]).select("word", "of"))
    apart = _sent(gram_gains, langs, False, n_langs, first) if grams_fit else None
    return known, _sent(head, langs, False, n_langs, first), apart


class Scorer:
    """Sums up texts; keeps the vectors of the words it has met, up to a bound; beyond it the later half is forgotten."""

    def __init__(self, model: Model, bound: int = 120_000):
        self.model, self.ids = model, {}
        self.bound = max(1000, min(bound, 8_000_000 // max(1, len(model.langs))))
        self.table = np.zeros((4096, len(model.langs)), np.int64)
        self.untold: set[str] = set()  # words that have to be joined

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > self.bound:
            self.ids = dict(itertools.islice(self.ids.items(), self.bound // 2))
            self.untold.intersection_update(self.ids)
            new = [w for w in words if w not in self.ids]
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            n = len(self.ids)
            while n + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n : n + len(part)], untold = self.model.vectors(part)
            self.ids.update(zip(part, range(n, n + len(part)), strict=True))
            self.untold.update(part[i] for i in np.flatnonzero(untold))

    def totals(self, texts: list[list[str]]) -> np.ndarray:
        """Sums of each text."""
        out = np.zeros((len(texts), len(self.model.langs)), np.int64)
        for i, words in enumerate(texts):
            for a in range(0, len(words), 50_000):
                out[i] += self.table[list(map(self.ids.__getitem__, words[a : a + 50_000]))].sum(axis=0)
        return out

    def words(self, texts: list[str | None]) -> list[list[str]]:
        """Words of each text, all of them learned."""
        found = [words_of_text(t) if t else [] for t in texts]
        self.learn(set(itertools.chain.from_iterable(found)))
        return found

    def score(self, words: list[str], total: np.ndarray) -> tuple[str, float]:
        if not words or not self.model.n_langs:
            return UNKNOWN, 0.0
        if not total.any():
            return self.model.first, 1.0 / self.model.n_langs
        best = int(total.argmax())  # the first of equals: languages are in order
        lacking = self.model.n_langs - len(total)  # nothing was sent of these
        return self.model.langs[best], float(1.0 / (np.exp((total - total[best]) / UNIT).sum() + lacking * math.exp(-total[best] / UNIT)))


def _batches(batches: Iterator[pd.Series]) -> Iterator[list[list[str | None]]]:
    """Texts of each batch, 200 at a time."""
    for texts in batches:
        texts = texts.where(texts.notna(), None).tolist()
        yield [texts[a : a + 200] for a in range(0, len(texts), 200)]


def _word_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """N-grams of all orders of each word, with how often it has them."""
    for batch in batches:
        words = batch["word"].tolist()
        for piece in _pieces(words, 200_000):
            marked, names = Marked(words[piece]), batch["word"].iloc[piece].to_numpy(object)
            for k in range(1, MAX_GRAM + 1):
                h, owner = marked.grams(k)
                found = pd.DataFrame({"owner": owner, "h": h.view(np.int64)}).groupby(["owner", "h"], sort=False).size()
                owners = found.index.get_level_values("owner")
                yield pd.DataFrame({"word": names[owners], "k": np.int32(k), "h": found.index.get_level_values("h"), "m": found.to_numpy()})


def _dealt_join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join of ``rows`` with a ``table`` that a key has few rows of, where a key may hold most of ``rows``; inner or left.

    Rows of a hot key are dealt over several parts, and its rows of the table repeated in each; fewer than 100,000 keys can be hot.
    """
    total = rows.count()
    bound = max(HOT, total // 100_000)
    # A hot key's bucket is hot, so only the keys of such buckets are counted; ten times as many buckets as could be hot, a million at most.
    bucket = F.pmod(F.xxhash64(*on), F.lit(10 * total // bound + 1))
    full = durable(rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > bound).select("b"))
    if full.isEmpty():
        return rows.join(table, on, how)
    counts = rows.join(F.broadcast(full), bucket == F.col("b"), "left_semi").groupBy(*on).agg(F.count(F.lit(1)).alias("c"))
    hot = durable(counts.where(F.col("c") > bound).select(*on, F.ceil(F.col("c") / bound).cast("int").alias("parts")))
    if hot.isEmpty():
        return rows.join(table, on, how)
    hot, parts = F.broadcast(hot), F.coalesce("parts", F.lit(1))
    left = rows.join(hot, on, "left").withColumn("part", F.pmod(F.xxhash64(*rows.columns), parts).cast("int")).drop("parts")
    right = table.join(hot, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, [*on, "part"], how).drop("part")


def _backed_off(words: DataFrame, known: Known, sent: Model | None) -> DataFrame:
    """``word, lang, gain`` of distinct unknown words: the mean of their longest n-grams that any is known of."""
    if sent is not None:  # all n-grams are with the executors
        grams = words.sparkSession.sparkContext.broadcast(sent)

        def back_off(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            langs = np.array(grams.value.langs, object)
            for batch in batches:
                words = batch["word"].tolist()
                for piece in _pieces(words, 100_000):
                    vectors = grams.value.backed_off(words[piece])
                    word, lang = np.nonzero(vectors)
                    yield pd.DataFrame({"word": np.array(words[piece], object)[word], "lang": langs[lang], "gain": vectors[word, lang]})

        return words.mapInPandas(back_off, "word string, lang string, gain long")
    grams = _stored(words.mapInPandas(_word_grams, "word string, k int, h long, m long"))
    # One row an n-gram tells how many of a word's are known of any language.
    per_gram = known.gains(known.grams).groupBy("k", "h").agg(F.collect_list(F.struct("lang", "gain")).alias("of"))
    met = _stored(_dealt_join(grams, per_gram, ["k", "h"]).select("word", "k", "m", "of"))
    longest = met.groupBy("word").agg(F.max("k").alias("k"))
    used = met.join(longest, ["word", "k"])
    size = used.groupBy("word").agg(F.sum("m").alias("size"))
    sums = used.select("word", "m", F.explode("of").alias("x")).groupBy("word", F.col("x.lang").alias("lang")).agg(F.sum(F.col("m") * F.col("x.gain")).alias("sum"))
    return sums.join(size, "word").select("word", "lang", F.expr("sum div size").alias("gain"))


def predict(docs: DataFrame, model: tuple[Known, Model, Model | None], *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``lang_pred`` and ``score``, the share of the best language in the posterior, to the columns ``keep`` (all).

    ``und`` with score 0 where the text is null or has no letter (by Unicode category), or the
    model no language; the first language where nothing of a text is known. A model that was sent whole needs
    one narrow stage. Else rows are written with their sums over the words that were sent and the counts of the others;
    these are joined to the table, and the distinct ones that it lacks back off. An empty table gives an empty one; texts are scored
    whole, whatever their length. Ties go to the language first in code point order; repeated rows
    and null ids each get their result; input columns of these names are replaced.
    """
    known, head, grams = model
    sent = docs.sparkSession.sparkContext.broadcast(head)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    kept = [F.col(f"`{c}`") for c in names]

    if head.whole:

        @F.pandas_udf("lang_pred string, score double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            scorer = Scorer(sent.value)
            for parts in _batches(batches):
                out = []
                for part in parts:
                    texts = scorer.words(part)
                    out += map(scorer.score, texts, scorer.totals(texts))
                yield pd.DataFrame(out, columns=["lang_pred", "score"])

        out = docs.select(*kept, score(F.col(f"`{text}`")).alias("__fl_lang"))
        return out.select(*kept, "__fl_lang.lang_pred", "__fl_lang.score")

    @F.pandas_udf("found boolean, totals array<long>, words array<string>, counts array<int>")
    def summed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for parts in _batches(batches):
            out = []
            for part in parts:
                texts = scorer.words(part)
                for ws, total in zip(texts, scorer.totals(texts).tolist(), strict=True):
                    others = {} if scorer.untold.isdisjoint(ws) else Counter(filter(scorer.untold.__contains__, ws))
                    out.append((bool(ws), total, list(others), list(others.values())))
            yield pd.DataFrame(out, columns=["found", "totals", "words", "counts"])

    rows = _stored(docs.select(*kept, summed(F.col(f"`{text}`")).alias("__fl_s")).withColumn("__fl_row", F.monotonically_increasing_id()))
    others = rows.select(F.col("__fl_row").alias("row"), F.explode(F.arrays_zip("__fl_s.words", "__fl_s.counts")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.counts").alias("m"))
    # One join tells what is known of each; words stay with those that nothing is known of.
    met = _dealt_join(others, known.words, ["word"], "left").select("row", "m", "of", F.when(F.col("of").isNull(), F.col("word")).alias("word"))
    met = _stored(met)
    own = met.select("row", "m", F.lit(0).alias("k"), F.explode("of").alias("x")).select("row", "m", "k", "x.lang", "x.n")
    unknown = met.where("word is not null").select("row", "m", "word")
    backed = _stored(_backed_off(unknown.select("word").distinct(), known, grams))
    per_word = backed.groupBy("word").agg(F.collect_list(F.struct("lang", "gain")).alias("of"))
    joined = _dealt_join(unknown, per_word, ["word"]).select("row", "m", F.explode("of").alias("x")).select("row", "m", "x.lang", "x.gain")
    joined = joined.unionByName(known.gains(own).drop("k")).select("row", "lang", (F.col("m") * F.col("gain")).alias("total"))
    # Sums over the words that were sent stay with their rows; those of the others, one array a row, are added to them.
    added = joined.groupBy("row", "lang").agg(F.sum("total").alias("total")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("lang", "total"))).alias("__fl_added"))
    met = rows.join(added.withColumnRenamed("row", "__fl_row"), "__fl_row", "left")
    langs = F.array(*[F.lit(x) for x in head.langs]) if head.langs else F.array().cast("array<string>")
    more = F.coalesce("__fl_added", F.create_map().cast("map<string,bigint>"))
    sums = F.concat(
        F.zip_with(langs, "__fl_s.totals", lambda lang, t: F.struct((t + F.coalesce(more[lang], F.lit(0))).alias("t"), lang.alias("lang"))),
        F.transform(F.array_except(F.map_keys(more), langs), lambda lang: F.struct(more[lang].alias("t"), lang.alias("lang"))),
    )
    # The negative of each positive sum; the least goes first, of equals the first language.
    least = F.transform(F.filter(sums, lambda x: x["t"] > 0), lambda x: F.struct((-x["t"]).alias("t"), x["lang"].alias("lang")))
    lacking = lambda all_, best: (F.lit(head.n_langs) - F.size(all_)) * F.exp(best["t"] / UNIT)
    share = lambda all_, best: 1.0 / (F.aggregate(all_, F.lit(0.0), lambda acc, x: acc + F.exp((best["t"] - x["t"]) / UNIT)) + lacking(all_, best))
    found = let(least, lambda all_: let(F.array_min(all_), lambda best: F.struct(best["lang"].alias("lang"), F.when(best.isNotNull(), share(all_, best)).alias("share"))))
    rows = met.withColumn("__fl_found", found).withColumn("__fl_best", F.col("__fl_found.lang")).withColumn("__fl_share", F.col("__fl_found.share"))
    told = F.col("__fl_s.found") & F.lit(head.n_langs > 0)
    pred = F.when(told, F.coalesce("__fl_best", F.lit(head.first))).otherwise(UNKNOWN)
    score = F.when(told, F.coalesce("__fl_share", F.lit(1.0 / max(1, head.n_langs)))).otherwise(0.0)
    return rows.select(*kept, pred.alias("lang_pred"), score.alias("score"))


def held_out(doc_id: str | Column = "doc_id", fold: int = 2, folds: int = 4) -> Column:
    """Whether a document is kept from learning: the remainder of its id's CRC-32."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))

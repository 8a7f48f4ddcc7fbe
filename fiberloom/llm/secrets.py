"""Secret scan: fixed patterns, and guess-cost dynamic programming over credential-context values."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiberloom.llm.common import give_back
from fiberloom.operators.tables import numbered

KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A match shorter than its minimum is dropped; maximal runs make these the same as ``+`` and a filter.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Wider contexts, whose values are judged by their guess cost: quoted values of any printable kind.
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|pwd|secret|token|api_?key|access_?key|private_?key|credentials?)["']?\x20*(?::=|=>|[:=])\x20*(?:"([^"\s]+)"|'([^'\s]+)'|([^\s"']+))""",
    re.IGNORECASE | re.ASCII,
)

#: Common password words by rank (fixed values), from the head of public frequency lists. The
#: dictionary goes on with the most frequent words of the corpus itself.
COMMON = (
    "password 123456 qwerty letmein admin welcome monkey dragon login princess master hello freedom whatever "
    "trustno1 iloveyou sunshine shadow superman football baseball starwars secret changeme default root test guest "
    "user pass access batman flower summer winter spring autumn monday friday example sample token dummy foobar "
    "hunter love money computer internet server service system database android google january february march april "
    "june july august september october november december the and for you that this with from have not your all"
).split()
#: Ranked words of the corpus that are kept; their lengths.
RANKED, SHORTEST, LONGEST = 20_000, 3, 24
#: Adjacent keys of a US keyboard, row by row (fixed values); walks go along or between rows.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
#: Keys of a walk, at most; longer ones are several.
LONGEST_WALK = 24
#: Characters that repeat, and times they do, at most; longer ones are several.
LONGEST_PERIOD, MOST_REPEATS = 12, 64
#: Common substitutions undone before the word lookup (fixed values).
PLAIN = str.maketrans("013457@$!", "oieastasi")
DAY, MONTH, YEAR = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:(?:19|20)[0-9]{2})"
#: Each matches in one way only from where it starts; and log10 of how many such dates there are.
DATES = ((re.compile(f"{YEAR}[-/.]?{MONTH}[-/.]?{DAY}"), math.log10(365 * 120)), (re.compile(f"{DAY}[-/.]?{MONTH}[-/.]?{YEAR}"), math.log10(365 * 120)), (re.compile(YEAR), math.log10(120)))
#: Each segment costs a factor of 2 for guessing where it starts, and so do capitals and substitutions.
SPLIT = math.log10(2)


def _neighbours() -> dict[str, set[str]]:
    at = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
    near = lambda p, q: p != q and abs(p[0] - q[0]) <= 1 and abs((p[1] + p[0] / 2) - (q[1] + q[0] / 2)) <= 1.01
    return {c: {d for d, q in at.items() if near(p, q)} for c, p in at.items()}


NEIGHBOURS = _neighbours()


def ranks(words: list[str] | None = None) -> dict[str, float]:
    """log10 of the rank of each known word: the common ones, then those of the corpus."""
    known = dict.fromkeys([*COMMON, *(words or ())])
    return {w: math.log10(i + 1) for i, w in enumerate(known)}


RANKS = ranks()
_WORD = re.compile(f"[a-z]{{{SHORTEST},}}")


def learn(docs: DataFrame, *, text: str = "text", keep: int = RANKED) -> list[str]:
    """The ``keep`` most frequent words of all whole texts, most frequent first, ties in code point order.

    Runs of ``SHORTEST`` to ``LONGEST`` ASCII letters, cases folded. Every text counts; the list is
    the dictionary's documented bound, and all that reaches the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        counts: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                counts.update(_WORD.findall(t.lower()))
                if len(counts) > 100_000:
                    yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                    counts.clear()
        if counts:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    rows = docs.select(F.col(f"`{text}`").alias("text")).where("text is not null").mapInPandas(count, "word string, n long")
    counts = rows.where(F.length("word") <= LONGEST).groupBy("word").agg(F.sum("n").alias("n"))
    # In ranges of a global order, so that the tasks together send what is kept, and not each of them as much.
    placed = numbered(counts, [F.desc("n"), "word"], "place").where(F.col("place") <= keep)
    return [r["word"] for r in sorted(placed.select("word", "place").collect(), key=lambda r: r["place"])]


def _brute(c: str) -> float:
    """log10 of the guesses for one character that fits no pattern."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33)


def guess_cost(value: str, floor: float = math.inf, known: dict[str, float] = RANKS) -> float:
    """log10 of the guesses of the cheapest segmentation of ``value``.

    ``best[i]`` is the least cost of the first i characters; a segment ending at i is a known word
    (rank, capitals and substitutions), a date, some characters repeated, a keyboard walk, or one
    brute-force character. Linear in the length, as every segment is bounded. Once every open
    state costs ``floor`` or more, no continuation is cheaper and it returns early.
    """
    n = len(value)
    best = [0.0] + [math.inf] * n
    low = value.lower()
    if len(low) != n:  # a character whose lower case is longer
        low = "".join(c if len(x := c.lower()) != 1 else x for c in value)
    plain = low.translate(PLAIN)
    brute = [0.0]
    for c in value:
        brute.append(brute[-1] + _brute(c))
    dates: dict[int, list[tuple[int, float]]] = {}
    for i in range(n):
        if "0" <= value[i] <= "9":
            for date, cost in DATES:
                if m := date.match(value, i):
                    dates.setdefault(m.end(), []).append((i, cost))
    runs = [0] * (LONGEST_PERIOD + 1)  # of characters that equal the one a period before
    walk, below = 0, 0
    for i in range(1, n + 1):
        cost = best[i - 1] + brute[i] - brute[i - 1]
        for k in range(SHORTEST, min(LONGEST, i) + 1):
            if (rank := known.get(low[i - k : i])) is not None:
                cost = min(cost, best[i - k] + SPLIT + rank + (0.0 if value[i - k : i] == low[i - k : i] else SPLIT))
            elif (rank := known.get(plain[i - k : i])) is not None:
                cost = min(cost, best[i - k] + 2 * SPLIT + rank + (0.0 if value[i - k : i] == low[i - k : i] else SPLIT))
        for start, guesses in dates.get(i, ()):
            cost = min(cost, best[start] + SPLIT + guesses)
        for p in range(1, min(LONGEST_PERIOD, i - 1) + 1):
            if value[i - 1] != value[i - 1 - p]:
                runs[p] = 0
                continue
            runs[p] += 1
            if runs[p] >= p:
                block = min(brute[i] - brute[i - p], known.get(value[i - p : i], math.inf))
                for times in range(2, min(runs[p] // p + 1, MOST_REPEATS) + 1):
                    cost = min(cost, best[i - times * p] + SPLIT + block + math.log10(times))
        walk = walk + 1 if i >= 2 and low[i - 1] in NEIGHBOURS.get(low[i - 2], ()) else 1
        for k in range(3, min(walk, LONGEST_WALK) + 1):
            cost = min(cost, best[i - k] + SPLIT + math.log10(len(NEIGHBOURS)) + 0.5 * (k - 1))
        best[i] = cost
        if cost < floor:
            below = i
        elif i - below > LONGEST_PERIOD * MOST_REPEATS:
            return floor
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def guess_spans(text: str, min_log10: float, known: dict[str, float] = RANKS) -> list[tuple[int, int, str]]:
    out = []
    for m in CONTEXT.finditer(text):
        k = m.lastindex
        if guess_cost(m[k], min_log10, known) >= min_log10:
            out.append((m.start(k), m.end(k), "guess"))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans) -> str:
    """The text with each covered stretch replaced by a mark; overlapping spans merge."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"


def scanner_udf(min_log10: float, sent, redact: bool = False):
    @F.pandas_udf(RESULT + (", redacted string" if redact else ""))
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = ranks(sent.value)
        for texts in batches:
            rows = []
            for null, text in zip(texts.isna(), texts.fillna(""), strict=True):
                base = base_spans(text)
                more = guess_spans(text, min_log10, known)
                spans = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base
                count = [sum(s[2] == k for s in base) for k in KINDS[:3]]
                row = (*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(more))
                rows.append((*row, None if null else redacted(text, spans) if spans else text) if redact else row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")] + ["redacted"] * redact)

    return scan


def scan(docs: DataFrame, *, text: str = "text", min_log10: float = 10.0, words: list[str] | None = None, redact: bool = False) -> DataFrame:
    """Append the counts, digest and spans of the secrets in every whole text; ``redacted`` where asked for.

    ``assign``, ``access`` and ``hex`` are fixed patterns; ``guess`` is a value in a credential
    context that takes 10**``min_log10`` guesses or more, given the ranked ``words`` (see
    ``learn``). Positions are code points, ends exclusive. One narrow stage without a shuffle, so
    an empty table gives an empty one. Texts are scanned whole, whatever their length. A null text
    counts as empty (and stays null when redacted); repeated rows and null ids each get their
    result; spans of equal start come in the order of ``KINDS``; input columns of the names
    appended are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(words or [])
    names = [c.split()[0] for c in RESULT.split(", ")] + ["redacted"] * redact
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    out = docs.select(*kept, scanner_udf(min_log10, sent, redact)(F.col(f"`{text}`")).alias("__fl_scan"))
    return out.select(*kept, *[F.col(f"__fl_scan.{c}").alias(c) for c in names])

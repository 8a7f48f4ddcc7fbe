"""Byte-pair encoding and decoding with a pair occurrence index.

All distinct pretokens of an Arrow batch are laid out as one symbol sequence. An index maps each
adjacent pair to all its positions; the active ranks are applied in ascending order, each to every
position of its pair, and the lists of the neighbouring pairs are updated as symbols merge. Merges
only create pairs of higher rank, so ascending order over the batch equals pretoken by pretoken.

Texts are cut into pretokens by the format's pattern; one with a character that the Unicode tables
of ``regex`` and of the tokenizers library class differently is cut by that library's pretokenizer.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import itertools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiberloom.llm.common import give_back

#: Fixed by the byte-level format: the pretoken pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pretokens remembered by one worker; beyond it the later half is forgotten, which changes no result.
CACHE_ENTRIES = 300_000
#: Bytes of text that are encoded at a time, about.
CHUNK = 2_000_000
#: Below this code point the Unicode tables of ``regex`` and of the tokenizers library agree.
AGREED_BELOW = 0x530

#: Pairs with as many positions are merged as vectors.
OFTEN = 24
#: Bits of a token id within a packed pair.
SHIFT = 24

RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the byte-level format: Latin-1 where visible, code points from 256 on elsewhere."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def fast_pattern() -> re.Pattern:
    """``PATTERN`` for texts below ``AGREED_BELOW``, its classes spelt out for the quicker ``re``."""

    def span(prop: str) -> str:
        member = regex.compile(prop)
        return "".join(re.escape(c) for c in map(chr, range(AGREED_BELOW)) if member.match(c))

    letters, digits, space = span(r"\p{L}"), span(r"\p{N}"), span(r"\s")
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+")


class PairIndexBPE:
    """Encoder and decoder for a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        to_bytes = lambda token: bytes(back[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.piece = {i: to_bytes(t) for t, i in vocab.items()}
        self.byte_id = [0] * 256
        for char, b in back.items():
            self.byte_id[b] = vocab[char]
        self.ranks: dict[int, int] = {}  # of a pair, packed into one number
        self.merges: list[tuple[int, int, int]] = []  # by rank: left, right, merged
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault(vocab[a] << SHIFT | vocab[b], len(self.merges))
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
        self.keys = np.array(sorted(self.ranks), np.int64)
        self.key_ranks = np.array([self.ranks[k] for k in self.keys.tolist()], np.int32)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = added
        self.piece |= {i: t.encode() for t, i in added.items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pretoken = regex.compile(PATTERN)
        self.fast, self.beyond = fast_pattern(), re.compile(f"[^\0-{chr(AGREED_BELOW - 1)}]")
        self.path, self.library, self.agrees = path, None, {}
        self.cache: dict[str, tuple[int, str, bytes]] = {}  # of a pretoken: number of ids, ids, bytes they decode to

    # pretokens ---------------------------------------------------------------------------------

    def _by_library(self, text: str) -> list[str]:
        """Pretokens where the two libraries' Unicode versions class a character differently."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def _agreed(self, char: str) -> bool:
        if char not in self.agrees:
            probe = f"a{char}1{char}!{char} x"
            self.agrees[char] = self.pretoken.findall(probe) == self._by_library(probe)
        return self.agrees[char]

    def _pretokens(self, text: str) -> list[str]:
        if not self.beyond.search(text):
            return self.fast.findall(text)
        if not all(ord(c) < AGREED_BELOW or self._agreed(c) for c in set(text)):
            return self._by_library(text)
        return self.pretoken.findall(text)

    def parts(self, text: str) -> list[str]:
        """Pretokens and added tokens of a text, in order; added tokens are told apart by ``self.added``."""
        if self.split_added is None or "<|" not in text and not self.split_added.search(text):
            return self._pretokens(text)
        out: list[str] = []
        for part in self.split_added.split(text):
            if part in self.added:
                out.append(part)
            elif part:
                out += self._pretokens(part)
        return out

    def _ranks_of(self, left, right) -> np.ndarray:
        """Rank of each pair, -1 where it has none."""
        keys = (np.asarray(left, np.int64) << SHIFT) + right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == keys) & (np.asarray(left) >= 0) & (np.asarray(right) >= 0), self.key_ranks[at], -1)

    # merging -----------------------------------------------------------------------------------

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """Ids of each pretoken, through one pair occurrence index over all of them."""
        symbol: list[int] = []
        starts: list[int] = []
        for w in words:
            starts.append(len(symbol))
            symbol += [self.byte_id[b] for b in w.encode("utf-8", "surrogatepass")]
            symbol.append(-1)  # no pair crosses a pretoken
        n = len(symbol)
        symbol, following, before = array("i", symbol), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        # The same memory as vectors, for the pairs that occur often.
        sym, nxt, prv = (np.frombuffer(x, np.int32) for x in (symbol, following, before))
        rank_of, index, active = self.ranks.get, {}, []
        push, pop = heapq.heappush, heapq.heappop

        def enlist(at: np.ndarray, left, right) -> None:
            """Add positions to the lists of the pairs that now stand there."""
            ranks = self._ranks_of(left, right)
            found = ranks >= 0
            at, ranks = at[found], ranks[found]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, where in zip(ranks[np.concatenate([[0], cuts])].tolist() if len(ranks) else (), np.split(at, cuts), strict=False):
                if rank not in index:
                    index[rank] = []
                    push(active, rank)
                index[rank] += where.tolist()

        enlist(np.arange(n - 1, dtype=np.int32), sym[:-1], sym[1:])
        while active:
            rank = pop(active)
            left, right, merged = self.merges[rank]
            where = index.pop(rank)
            if len(where) >= OFTEN and left != right:
                i = np.sort(np.array(where, np.int32))
                i = i[(sym[i] == left) & (sym[nxt[i]] == right)]
                i = i[np.concatenate([[True], i[1:] != i[:-1]])] if len(i) else i
                j = nxt[i]
                k = nxt[j]
                sym[i], sym[j] = merged, -2
                nxt[i], prv[k] = k, i
                enlist(i, merged, sym[k])
                h = prv[i]
                enlist(h, np.where(h >= 0, sym[h], -1), merged)
                continue
            for i in sorted(where):
                j = following[i]
                if symbol[i] != left or symbol[j] != right:
                    continue  # an earlier merge took one of the two
                symbol[i], symbol[j] = merged, -2
                k = following[i] = following[j]
                before[k] = i  # a separator ends every pretoken, so k is in range
                if (new := rank_of(merged << SHIFT | symbol[k])) is not None:
                    if new in index:
                        index[new].append(i)
                    else:
                        index[new] = [i]
                        push(active, new)
                k = before[i]
                if k >= 0 and (new := rank_of(symbol[k] << SHIFT | merged)) is not None:
                    if new in index:
                        index[new].append(k)
                    else:
                        index[new] = [k]
                        push(active, new)
        out = []
        for start in starts:
            ids, i = [], start
            while symbol[i] != -1:
                ids.append(symbol[i])
                i = following[i]
            out.append(ids)
        return out

    def _learn(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self.cache]
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            # What was met first is what is met often.
            self.cache = dict(itertools.islice(self.cache.items(), CACHE_ENTRIES // 2))
            new = [p for p in parts if p not in self.cache]
        plain = [p for p in new if p not in self.added]
        found = [*zip(plain, self.merge_all(plain), strict=True), *((p, [self.added[p]]) for p in new if p in self.added)]
        for p, ids in found:
            self.cache[p] = (len(ids), ",".join(map(str, ids)), self.decoded(ids))

    def encode(self, text: str) -> list[int]:
        parts = self.parts(text)
        self._learn(set(parts))
        return [int(i) for p in parts for i in self.cache[p][1].split(",")]

    def decoded(self, ids) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decoded(ids).decode("utf-8", "replace")


@functools.lru_cache(1)
def shared(path: str) -> PairIndexBPE:
    """One model for each Python worker, which keeps its pretokens from task to task."""
    return PairIndexBPE(path)


def _chunks(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``CHUNK`` bytes of text, so that neither the index nor the results pile up."""
    start = size = 0
    for i, n in enumerate(lengths):
        size += n
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def encoded(model: PairIndexBPE, texts: list[str | None], with_ids: bool) -> list[pa.Array]:
    """Number of ids, digest of the ids and of the decoded text (and the ids) of each text."""
    gc.disable()  # many short lists and strings, none of them in a cycle
    try:
        parts = [model.parts(t) if t else [] for t in texts]
        model._learn({p for ps in parts for p in ps})
        counts, digests, back, ids = [], [], [], []
        for ps in parts:
            n, strings, pieces = zip(*map(model.cache.__getitem__, ps), strict=True) if ps else ((), (), ())
            joined = ",".join(strings)
            counts.append(sum(n))
            digests.append(hashlib.sha256(joined.encode()).hexdigest())
            back.append(hashlib.sha256(b"".join(pieces).decode("utf-8", "replace").encode()).hexdigest())
            if with_ids:
                ids.append(np.fromstring(joined, dtype=np.int32, sep=",") if joined else np.zeros(0, np.int32))
    finally:
        gc.enable()
    out = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
    if with_ids:
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)), type=pa.list_(pa.field("element", pa.int32()))))
    return out


def encode(docs: DataFrame, tokenizer: str, *, text: str = "text", with_ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Append ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` (and ``ids``) to every row, or to its ``keep`` columns.

    One narrow stage: nothing is shuffled, and a lost task is simply run again. A null text counts
    as empty (no ids, the digest of the empty string). Repeated rows and null ids each get their
    result; an empty table gives an empty one. Input columns of the names appended are replaced.
    Texts of any length are encoded whole; the index covers a bounded chunk of rows at a time, and
    what comes back to Spark is as small.
    """
    new = T._parse_datatype_string(RESULT + (", ids array<int>" if with_ids else ""))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    schema = T.StructType([docs.schema[c] for c in kept] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        model = shared(tokenizer)
        give_back()  # what reading the tokenizer took
        for batch in batches:
            columns = batch.columns
            lengths = pc.fill_null(pc.binary_length(columns[-1]), 0).to_pylist()
            for a, b in _chunks(lengths):
                found = encoded(model, columns[-1].slice(a, b - a).to_pylist(), with_ids)
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in columns[:-1]] + found, names=schema.names)
            del batch, columns, lengths  # not held while the next one comes

    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__fl_text"))
    return source.mapInArrow(run, schema)

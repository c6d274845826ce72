"""Token counts: heap-and-linked-list byte-pair merging.

A word's count is its number of bytes minus the merges done on it; no token identifier is produced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The white space and the splitting pattern of byte-level pair encodings.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
PLACE = (1 << 40) - 1


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairCounter(dict):
    """Counts the tokens of texts under one byte-level pair vocabulary (the content of its .json file); holds the counts of pieces that follow a space."""

    def __init__(self, spec: str, cache_words: int = 1_000_000):
        d = json.loads(spec)
        pre = d["pre_tokenizer"]
        if d["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or d["normalizer"]:
            raise ValueError("only plain byte-level pair encodings are counted")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in d["added_tokens"]):
            raise ValueError("added tokens that take in white space are not supported")
        # symbols are numbered inside: one for each byte, one for each string that a merge makes
        symbol = byte_symbols()
        number = {symbol[b]: b for b in range(256)}
        # and a pair is kept as two of them in one number, its rank above the bits that hold a place in a word
        self.rank: dict[int, int] = {}
        self.made: dict[int, int] = {}
        for i, pair in enumerate(d["model"]["merges"]):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            r = (i + 1) * (PLACE + 1)
            self.rank[number[x] << 24 | number[y]] = r
            self.made[r] = number.setdefault(x + y, len(number))
        self.first = {(x, y): r for x in range(256) for y in range(256) if (r := self.rank.get(x << 24 | y))}
        special = sorted((t["content"] for t in d["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words = regex.compile(PATTERN)
        self.runs = re.compile(f" [{SPACE}]|[{SPACE}] ")
        self.most, self.word = cache_words, {}

    def merged(self, word: str) -> int:
        """Tokens of one word: pops the lowest-ranked adjacent pair from a heap, links its neighbours, offers the new pairs."""
        raw = word.encode("utf-8", "surrogatepass")
        n, rank, made = len(raw), self.rank.get, self.made
        heap = [r + i for i, r in enumerate(map(self.first.get, zip(raw, raw[1:]))) if r]
        if not heap:
            return n
        heapify(heap)
        sym, nxt, prv, left = [*raw, -1], list(range(1, n + 2)), list(range(-1, n)), n
        while heap:
            top = heappop(heap)
            i = top & PLACE
            a = sym[i]
            j = nxt[i]
            top -= i
            if a < 0 or rank(a << 24 | sym[j]) != top:
                continue  # an earlier merge has taken one of the two
            sym[i] = a = made[top]
            sym[j] = -1
            nxt[i] = k = nxt[j]
            left -= 1
            if k < n:
                prv[k] = i
                if r := rank(a << 24 | sym[k]):
                    heappush(heap, r + i)
            if i and (r := rank(sym[p := prv[i]] << 24 | a)):
                heappush(heap, r + p)
        return left

    def __missing__(self, piece: str) -> int:
        """Tokens of a space and a piece of text; pieces and words recur, so counts are kept up to a bound."""
        n = 0
        for w in self.words.findall(" " + piece):
            if (m := self.word.get(w)) is None:
                m = self.merged(w)
                if len(w) <= 48:
                    if len(self.word) >= self.most:
                        self.word.clear()
                    self.word[w] = m
            n += m
        if len(piece) <= 48 and n:
            if len(self) >= self.most:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(map(self.plain, parts))

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings: no word crosses a lone space, and each space belongs to what follows."""
        if self.runs.search(text):
            return sum(map(self.whole, self.words.findall(text)))
        first, *rest = text.split(" ")
        return sum(map(self.whole, self.words.findall(first))) + sum(map(self.__getitem__, rest))

    def whole(self, word: str) -> int:
        n = self.word.get(word)
        return self.merged(word) if n is None else n


_counters: dict[int, PairCounter] = {}


def _counter(spec) -> PairCounter:
    """One counter a vocabulary and worker process: tasks that run in it later find its words."""
    key = hash(spec.value)
    if key not in _counters:
        _counters.clear()
        _counters[key] = PairCounter(spec.value)
    return _counters[key]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 512) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit).

    vocabulary is the path of a tokenizer .json file, read by the driver and broadcast: its size is fixed. A null or
    empty text has 0 bytes and 0 tokens. Rows are independent, so ties, repeated rows and an empty table need nothing
    special; columns of docs with the names of the results are replaced. Long texts are walked piece by piece.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(spec)
        for texts in batches:
            yield texts.map(counter.count, na_action=None).astype("int64")

    out = docs.withColumn("n_tokens", tokens(F.coalesce(F.col(text), F.lit(""))))
    return out.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn("over_limit", F.col("n_tokens") > limit)

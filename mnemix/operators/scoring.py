"""Models behind decisions: what a scorer and an embedder must offer, deterministic stand-ins, and their use on columns.

Both run in Arrow batches on the executors. No model weights are at hand, so the stand-ins compute from hashes; a real
model takes their place by the same two methods.
"""

from __future__ import annotations

import hashlib
import sys
import zlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    def logits(self, rows: list[tuple[str, str, list[str], str]]) -> list[list[float]]:
        """For each (kind, instructions, options, state) a logit an option."""


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:4], 16)


class HashEmbedder:
    """Mean of signed unit vectors of the space-separated words, then of length one; a text without words is zero."""

    def __init__(self, dim: int = 16):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for w in filter(None, (text or "").lower().split(" ")):
                h = hashlib.md5(w.encode()).hexdigest()
                row[int(h[:4], 16) % self.dim] += 1.0 if int(h[4], 16) < 8 else -1.0
        return out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-12)


class HashScorer:
    """A logit between 0 and 4 from a hash of all that a row says of an option, and a twentieth for each place in the row."""

    def __init__(self, dim: int = 16):
        self.dim = dim

    def logits(self, rows):
        return [[4 * _number("|".join((kind, instructions, o, state))) / 65535 + 0.05 * i for i, o in enumerate(options)] for kind, instructions, options, state in rows]

    def pooled(self, rows) -> np.ndarray:
        return HashEmbedder(self.dim).embed([f"{instructions} {state}" for _, instructions, _, state in rows])


class WordEncoder:
    """Words as numbers above the four special ones."""

    cls, sep, mask, pad = 0, 1, 2, 3

    def encode(self, text: str) -> list[int]:
        return [4 + zlib.crc32(w.encode()) % 30000 for w in text.split()]


def model_sequence(encoder, state: str, head: str, options: list[str], most: int = 512, most_head: int = 256, keep_end: bool = False) -> tuple[list[int], list[int]]:
    """(ids, places of the options' masks): start, head, end, a mask before each option, end, state, end.

    Options have 48 tokens at most; where they leave the head fewer than 16 of most_head, each is cut to an equal share,
    four at least, and the head keeps eight at least. The state gets what is left of most, from its beginning, or, of a
    conversation, its end.
    """
    coded = [encoder.encode(o)[:48] for o in options]
    spare = lambda: most_head - sum(len(c) + 1 for c in coded)
    if spare() < 16:
        share = max(4, (most_head - 16) // max(1, len(coded)))
        coded = [c[: share - 1] for c in coded]
    ids = [encoder.cls, *encoder.encode(head)[: max(8, spare())], encoder.sep]
    places = []
    for c in coded:
        places.append(len(ids))
        ids += [encoder.mask, *c]
    ids.append(encoder.sep)
    room = max(0, most - len(ids) - 1)
    tokens = encoder.encode(state)
    ids += (tokens[len(tokens) - min(room, len(tokens)) :] if keep_end else tokens[:room]) + [encoder.sep]
    return ids[:most], [p for p in places if p < most]


class SequenceScorer:
    """Scores by token sequences as a network would be fed: rows of like length go through `run` eight at a time."""

    def __init__(self, encoder, run, most: int = 512, most_head: int = 256, batch: int = 8):
        self.encoder, self.run, self.most, self.most_head, self.batch = encoder, run, most, most_head, batch

    def logits(self, rows):
        made = [model_sequence(self.encoder, state, f"{kind} question: {instructions}", options, self.most, self.most_head, state.lstrip().startswith("[")) for kind, instructions, options, state in rows]
        for (_, _, options, _), (_, places) in zip(rows, made):
            if len(places) < len(options):
                raise ValueError(f"only {len(places)} of {len(options)} options fit in {self.most} tokens")
        out: list = [None] * len(rows)
        order = sorted(range(len(rows)), key=lambda i: len(made[i][0]))
        for at in range(0, len(order), self.batch):
            some = order[at : at + self.batch]
            for i, got in zip(some, self.run([made[i] for i in some])):
                out[i] = got
        return out


VECTOR = ArrayType(DoubleType())


def embedded(text: Column, embedder: Embedder) -> Column:
    @F.pandas_udf(VECTOR)
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.embed([t or "" for t in texts])), dtype=object)

    return embed(text)


def _rows(kinds, instructions, options, states) -> list[tuple]:
    return [(k, i, list(o), s or "") for k, i, o, s in zip(kinds, instructions, options, states)]


def logits(kind: Column, instructions: Column, options: Column, state: Column, scorer: Scorer) -> Column:
    @F.pandas_udf(VECTOR)
    def score(k: pd.Series, i: pd.Series, o: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, x)) for x in scorer.logits(_rows(k, i, o, s))], dtype=object)

    return score(kind, instructions, options, state)


def pooled_vectors(kind: Column, instructions: Column, options: Column, state: Column, scorer) -> Column:
    """The model's own vector of each (state, question)."""
    if not hasattr(scorer, "pooled"):
        raise ValueError("this model gives no pooled vectors")

    @F.pandas_udf(VECTOR)
    def pool(k: pd.Series, i: pd.Series, o: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series(list(scorer.pooled(_rows(k, i, o, s))), dtype=object)

    return pool(kind, instructions, options, state)


def similarities(text: Column, others: list[str], embedder: Embedder) -> Column:
    """Cosines of each text with a fixed list of texts, which is as long as a question has options; to nine places, so that ties fall to the order."""
    fixed = embedder.embed(list(others))

    @F.pandas_udf(VECTOR)
    def compare(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.round(embedder.embed([t or "" for t in texts]) @ fixed.T, 9)), dtype=object)

    return compare(text)


def refreshed_embeddings(nodes: DataFrame, old: DataFrame, embedder: Embedder) -> DataFrame:
    """(node_id, hash, vec): old rows of nodes whose label and text hash as before, and new vectors of the others.

    nodes: node_id, label, text; only records are embedded. Vectors of nodes that are gone go, too.
    """
    now = nodes.filter(F.col("node_id").startswith("F_")).select("node_id", F.concat_ws("\n", "label", "text").alias("of")).withColumn("hash", F.xxhash64("of"))
    kept = old.join(now.select("node_id", "hash"), ["node_id", "hash"], "left_semi").select("node_id", "hash", "vec")
    new = now.join(kept.select("node_id"), "node_id", "left_anti").select("node_id", "hash", embedded(F.col("of"), embedder).alias("vec"))
    return kept.unionByName(new)

# what runs on executors travels with the plan, so they need not hold this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

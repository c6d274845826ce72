"""Quality classifier: positive-unlabelled learning with a non-negative risk.

A small network over counts of a text's surface minimises the non-negative unbiased risk: with class prior p, positive
risk p E+[l(g)] plus max(0, Eu[l(-g)] - p E+[l(-g)]); where the second part falls below zero, the step goes up it.
Trusted positives are labelled 1; the unlabelled sample is web text regardless of label. No negative is used: the prior,
too, is estimated from positive and unlabelled texts, as the least ratio of their shares above a threshold of a first
network's score on texts it was not fitted on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemix.llm.common import fold, sample_hash

N_FEATURES = 17
MARK = np.zeros(256, bool)
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
PROSE = [ord(c) for c in ".,'-"]  # marks that any prose has


def features(text: str | None) -> np.ndarray:
    """Counts and shares of the whole text; zeros for an empty one."""
    out = np.zeros(N_FEATURES)
    words = (text or "").split()
    if not words:
        return out
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    raw = np.bincount(b, minlength=256)
    size = raw.sum()
    upper, digit = raw[65:91].sum(), raw[48:58].sum()
    high = raw[128:].sum()
    n = len(words)
    times = Counter(words)
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), np.int64, n)
    same = sum(a == b for a, b in zip(words, words[1:]))
    fives = len(set(zip(words, words[1:], words[2:], words[3:], words[4:])))
    bare = sum(k for w, k in times.items() if len(w) <= 3 and not any(map(str.isalnum, w)))  # words that are marks only
    doubled = (MARK[b[1:]] & (b[1:] == b[:-1])).sum()
    other = np.where(MARK, raw, 0)
    other[PROSE] = 0
    out[:] = [
        np.log1p(n), lengths.mean(), lengths.std(), len(times) / n, max(times.values()) / n, same / n, fives / max(1, n - 4),
        upper / size, digit / size, high / size, raw[MARK].sum() / size, bare / n, doubled / n, other.max() / n,
        raw[46] / n, len(set(lines)) / len(lines), np.log1p(size / len(lines)),
    ]
    return out


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives among the unlabelled, from scores of both: the least ratio of their shares above a threshold.

    Negatives only add to the unlabelled share, so every ratio is at least the prior but for chance; the threshold
    chosen is the one with the least upper confidence bound, sampling error of both shares included.
    """
    p, u = np.sort(positive)[::-1], np.sort(unlabelled)[::-1]
    above = np.searchsorted(-u, -p, side="right") / len(u)
    share = np.arange(1, len(p) + 1) / len(p)
    slack = np.sqrt(np.log(4 / doubt) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = int(((above + slack) / share).argmin())
    return float(np.clip(above[best] / share[best], 0.05, 0.95))


class Net:
    """One hidden layer over standardised features; g > 0 leans to the positive class."""

    def __init__(self, hidden: int = 16, seed: int = 0):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.w = [r.normal(0, 0.4, (N_FEATURES, hidden)), np.zeros(hidden), r.normal(0, 0.4, hidden), np.zeros(1)]
        self.prior = 0.5

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))

    def _grad(self, x: np.ndarray, up: np.ndarray) -> list[np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ self.w[0] + self.w[1])
        dh = up[:, None] * self.w[2] * (1 - h * h)
        return [z.T @ dh, dh.sum(0), h.T @ up, np.array([up.sum()])]

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, batch: int = 512, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        self.prior = prior
        self.mean, self.scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
        m, s = [np.zeros_like(v) for v in self.w], [np.zeros_like(v) for v in self.w]
        for i in range(1, steps + 1):
            xp = positive[r.integers(0, len(positive), batch)]
            xu = unlabelled[r.integers(0, len(unlabelled), batch)]
            gp, gu = self.logit(xp), self.logit(xu)
            sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            if negative >= 0:
                grad = [a + b for a, b in zip(self._grad(xp, (prior * (sp - 1) - prior * sp) / batch), self._grad(xu, su / batch))]
            else:  # the unbiased estimate has gone below zero: undo the overfit
                grad = [a + b for a, b in zip(self._grad(xp, prior * sp / batch), self._grad(xu, -su / batch))]
            now = rate * (1 - 0.95 * i / steps)
            for k, g in enumerate(grad):
                g = g + decay * self.w[k]
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                self.w[k] = self.w[k] - now * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8)


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 4000, most_unlabelled: int = 12000, folds: int = 5) -> Net | None:
    """The network, from training rows only (crc32 of the id modulo folds is not 0); None without a trusted or any unlabelled row.

    The bounds on sampled rows are most_positive and most_unlabelled; rows are chosen by a hash of their id. First
    networks are fitted on half of both samples; their scores of the other halves give the prior, under which the
    network is fitted on all.
    """
    spark = docs.sparkSession
    known = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != 0)).select(F.col("doc_id").alias("t_id")).distinct()
    n = known.count()
    if not n:
        return None
    trusted = known.filter(sample_hash(F.lit(1), "t_id") < min(1.0, most_positive / n)).collect()
    ids = F.broadcast(spark.createDataFrame([(r.t_id,) for r in trusted], "t_id long"))  # at most about most_positive
    web = docs.select("doc_id", "text").filter(fold(F.col("doc_id"), folds) != 0)
    in_sample = sample_hash(F.lit(2), "doc_id", "text") < min(1.0, most_unlabelled / max(1, web.count()))
    picked = web.join(ids, F.col("doc_id") == F.col("t_id"), "left").select("text", F.col("t_id").isNotNull().alias("trusted"), in_sample.alias("sampled")).filter("trusted or sampled")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"trusted": b["trusted"], "sampled": b["sampled"], "x": [features(t) for t in b["text"]]})

    rows = picked.mapInPandas(measure, "trusted boolean, sampled boolean, x array<double>").toPandas()
    if not rows["trusted"].any() or not rows["sampled"].any():
        return None
    x = np.array(rows["x"].tolist())
    order = np.lexsort(x.T)  # independent of the order of tasks
    x, trusted, sampled = x[order], rows["trusted"].to_numpy(bool)[order], rows["sampled"].to_numpy(bool)[order]
    p, u = x[trusted], x[sampled]
    prior = 0.5
    if min(len(p), len(u)) > 1:
        for _ in range(3):  # the better the prior, the better the network that estimates it
            first = Net()
            first.fit(p[::2], u[::2], prior, steps=800)
            prior = class_prior(first.logit(p[1::2]), first.logit(u[1::2]))
    net = Net()
    net.fit(p, u, prior)
    return net


def score(docs: DataFrame, net: Net | None, threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold).

    A null text counts as empty; without a network, as where nothing is labelled, every score is 0.5. Rows are
    independent; columns of docs with these names are replaced.
    """
    if net is None:
        return docs.withColumn("score", F.lit(0.5)).withColumn("predicted", (F.lit(0.5) >= threshold).cast("int"))

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(net.score(np.array([features(t) for t in texts])) if len(texts) else [], dtype="float64")

    return docs.withColumn("score", rate("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

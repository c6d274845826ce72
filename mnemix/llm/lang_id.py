"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The network reads windows of a text's bytes in both directions, gives every position a distribution over the learned
languages, and pools the positions of the whole text into document probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemix.llm.common import fold, sample_hash

HALVES = ("f", "b")


class ByteGRU:
    """weights: per direction x (256, 3H) inputs by byte, u (H, 3H) recurrence; output o_f, o_b (H, L), bias o (L)."""

    def __init__(self, labels: list[str], hidden: int = 8, seed: int = 0):
        self.labels, self.hidden = labels, hidden
        r = np.random.default_rng(seed)
        n = len(labels)
        self.w = {"o": np.zeros(n)}
        for d in HALVES:
            self.w |= {f"x{d}": r.normal(0, 0.5, (256, 3 * hidden)), f"u{d}": r.normal(0, 0.4, (hidden, 3 * hidden)), f"o{d}": r.normal(0, 0.4, (hidden, n))}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    # training -----------------------------------------------------------------------------------------------------

    def _forward(self, x: np.ndarray, d: str):
        H, n, T = self.hidden, len(x), x.shape[1]
        h, kept, out = np.zeros((n, H), np.float32), [], [None] * T
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            a, g = self.w[f"x{d}"][x[:, t]], h @ self.w[f"u{d}"]
            zr = 1 / (1 + np.exp(-(a[:, : 2 * H] + g[:, : 2 * H])))
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(a[:, 2 * H :] + r * g[:, 2 * H :])
            kept.append((t, h, z, r, c, g[:, 2 * H :]))
            h = c + z * (h - c)
            out[t] = h
        return np.stack(out, 1), kept

    def _backward(self, x: np.ndarray, d: str, kept: list, up: np.ndarray, grad: dict) -> None:
        H = self.hidden
        gx, gu, u = grad[f"x{d}"], grad[f"u{d}"], self.w[f"u{d}"]
        dh = np.zeros((len(x), H), np.float32)
        for t, h, z, r, c, gc in reversed(kept):
            dh = dh + up[:, t]
            dc = dh * (1 - z) * (1 - c * c)
            da = np.concatenate([dh * (h - c) * z * (1 - z), dc * gc * r * (1 - r), dc], 1)
            dg = np.concatenate([da[:, : 2 * H], dc * r], 1)
            gu += h.T @ dg
            gx += _by_byte(x[:, t], da)
            dh = dh * z + dg @ u.T

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all positions, and its gradient by backpropagation through time."""
        out = {d: self._forward(x, d) for d in HALVES}
        logit = sum(out[d][0] @ self.w[f"o{d}"] for d in HALVES) + self.w["o"]
        p = np.exp(logit - logit.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        rows = np.arange(len(x))
        value = -float(np.log(p[rows, :, y] + 1e-12).mean())
        p[rows, :, y] -= 1
        p /= x.size
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["o"] += p.sum((0, 1))
        for d in HALVES:
            grad[f"o{d}"] += np.einsum("nth,ntl->hl", out[d][0], p)
            self._backward(x, d, out[d][1], p @ self.w[f"o{d}"].T, grad)
        return value, grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 220, batch: int = 192, rate: float = 0.02, seed: int = 0) -> list[float]:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        for i in range(1, steps + 1):
            pick = r.integers(0, len(x), min(batch, len(x)))
            value, grad = self.loss(x[pick], y[pick])
            losses.append(value)
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                now = rate * (1 - 0.9 * i / steps)
                self.w[k] -= (now * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return losses

    # prediction ---------------------------------------------------------------------------------------------------

    def positions(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(T, N, L) probabilities of every position of N windows; mask is False on padding, which leaves no trace."""
        H, (T, n) = self.hidden, x.shape
        logit = np.empty((T, n, len(self.labels)), np.float32)
        for d in HALVES:
            # sigmoid(v) = (1 + tanh(v / 2)) / 2
            wx, u, o = self.w[f"x{d}"], self.w[f"u{d}"], self.w[f"o{d}"]
            x_gate, u_gate, x_cand, u_cand = (np.ascontiguousarray(v) for v in (wx[:, : 2 * H] / 2, u[:, : 2 * H] / 2, wx[:, 2 * H :], u[:, 2 * H :]))
            full = mask.all(axis=1)
            h = np.zeros((n, H), np.float32)
            for t in range(T) if d == "f" else range(T - 1, -1, -1):
                gate = x_gate[x[t]]
                gate += h @ u_gate
                np.tanh(gate, out=gate)
                gate *= 0.5
                gate += 0.5
                c = h @ u_cand
                c *= gate[:, H:]
                c += x_cand[x[t]]
                np.tanh(c, out=c)
                h -= c
                h *= gate[:, :H]
                h += c
                if not full[t]:
                    h *= mask[t][:, None]
                if d == "f":
                    np.matmul(h, o, out=logit[t])
                else:
                    logit[t] += h @ o
        logit += self.w["o"]
        logit -= logit.max(axis=2, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(axis=2, keepdims=True)
        logit *= mask[:, :, None]
        return logit

    def pooled(self, texts: list[str], window: int = 128, batch: int = 2048) -> np.ndarray:
        """(texts, L) mean probabilities over all bytes of each whole text; an empty text gets equal ones."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        total = np.zeros((len(raw), len(self.labels)))
        spans = ((i, at) for i, b in enumerate(raw) for at in range(0, len(b), window))
        while part := [s for _, s in zip(range(batch), spans)]:
            x = np.zeros((len(part), window), np.uint8)
            n = np.zeros(len(part), int)
            for j, (i, at) in enumerate(part):
                b = raw[i][at : at + window]
                n[j] = len(b)
                x[j, : len(b)] = np.frombuffer(b, np.uint8)
            mask = np.arange(window)[:, None] < n[None]
            got = self.positions(np.ascontiguousarray(x.T), mask).sum(axis=0, dtype=np.float64)
            owner = np.array([i for i, _ in part])
            for c in range(got.shape[1]):
                total[:, c] += np.bincount(owner, got[:, c], len(raw))
        size = np.array([len(b) for b in raw])[:, None]
        return np.where(size > 0, total / np.maximum(size, 1), 1 / len(self.labels))

    def label_positions(self, text: str, window: int = 128) -> list[str]:
        """The label of every byte of one text."""
        b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        out: list[str] = []
        for at in range(0, len(b), window):
            x = b[at : at + window][:, None]
            out += [self.labels[i] for i in self.positions(x, np.ones(x.shape, bool))[:, 0].argmax(1)]
        return out


def _by_byte(bytes_: np.ndarray, rows: np.ndarray) -> np.ndarray:
    order = np.argsort(bytes_, kind="stable")
    keys, at = np.unique(bytes_[order], return_index=True)
    out = np.zeros((256, rows.shape[1]), np.float32)
    out[keys] = np.add.reduceat(rows[order], at, axis=0)
    return out


def training_windows(docs: DataFrame, most_docs: int = 600, windows: int = 4, width: int = 96) -> pd.DataFrame:
    """(lang, piece): up to about most_docs documents a label, chosen by a hash of id and text, and pieces at hashed places of each.

    The bound on labelled rows is most_docs; pieces are cut on the executors, so the driver gets a bounded amount of
    text. Labels of fewer documents give all of theirs.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold(F.col("doc_id"), 4) != 2))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return pd.DataFrame({"lang": [], "piece": []})
    share = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, most_docs / n))])
    some = known.filter(sample_hash("doc_id", "text") < share[F.col("lang")])
    at = [(F.lit(1) + F.floor(sample_hash(F.lit(i), "doc_id", "text") * F.greatest(F.length("text") - width, F.lit(1)))).cast("int") for i in range(windows)]
    got = some.select("lang", F.explode(F.array(*[F.substring("text", a, F.lit(width)) for a in at])).alias("piece"))
    return got.toPandas().sort_values(["lang", "piece"], kind="stable").reset_index(drop=True)


def train(docs: DataFrame, hidden: int = 8, width: int = 64, steps: int = 220, most_docs: int = 600) -> ByteGRU | None:
    """The network, or None where no document has a label and a letter."""
    pieces = training_windows(docs, most_docs)
    labels = sorted(pieces["lang"].unique())
    if not labels:
        return None
    net = ByteGRU(labels, hidden)
    x = np.zeros((len(pieces), width), np.uint8)
    for i, p in enumerate(pieces["piece"]):
        b = p.encode("utf-8", "replace")
        x[i] = np.resize(np.frombuffer(b, np.uint8), width)  # a short piece is repeated
    y = np.searchsorted(labels, pieces["lang"].to_numpy())
    if len(labels) > 1:
        net.fit(x, y, steps)
    return net


def predict(docs: DataFrame, net: ByteGRU | None) -> DataFrame:
    """docs with lang_pred and score, the pooled probability of that label.

    A null text and one without a letter are `und` with score 0, as is everything if there is no network. Ties go to
    the label first in order. Rows are independent; columns of docs with these names are replaced.
    """
    labelled = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))

    @F.pandas_udf("struct<lang_pred string, score double>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            has = texts.notna().to_numpy()
            p = np.zeros((len(texts), len(net.labels)))
            p[has] = net.pooled(texts[has].tolist())
            best = p.argmax(axis=1)
            names = np.array([*net.labels, "und"], dtype=object)[np.where(has, best, len(net.labels))]
            yield pd.DataFrame({"lang_pred": names, "score": np.where(has, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)})

    got = docs.select(F.struct(*docs.columns).alias("doc"), label(F.when(labelled, F.col("text"))).alias("label"))
    return got.select(*[F.col(f"doc.`{c}`") for c in docs.columns if c not in ("lang_pred", "score")], "label.lang_pred", "label.score")

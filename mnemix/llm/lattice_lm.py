"""LM scoring: subword lattice likelihood.

A text is words and one end. A word is written by the pieces of an existing vocabulary: all its segmentations count,
each by the product of its pieces' probabilities, and a log-space forward recursion adds them up. The vocabulary's own
scores are the starting weights; expected piece counts over all training words (forward-backward) re-estimate them.
The document's probability (lattice_score) is the product over its words and end. The mixture (score) also gives a training word an arc of
its own across the whole word, weighted by a share chosen so that training words are best predicted by the others
(leave-one-out), a departure from the method, and lets a text repeat its words as drawn from an urn.

Texts of several languages are a mixture: each document belongs to one of a few clusters of byte pairs, every cluster
has piece probabilities, word counts and shares of its own, and a word's arc also draws on the counts of all clusters.

Words are handled once a cluster: documents are packed into chunks of one cluster (a dictionary of the chunk's words
and, for each document, places in it), dictionaries are counted and scored by word, and the scores go back to their
chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemix.llm.common import fold, saved

MULT = np.uint64(0x9E3779B97F4A7C15)
SLOTS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x94D049BB133111EB))
START = 32  # a space opens each word; no word holds one
PLAIN = 40  # bytes up to which products of probabilities stay far from the least double


class Vocabulary:
    """Pieces as byte strings with their starting log probabilities; every single byte is a piece."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp = pieces, logp
        self.longest = max(map(len, pieces))
        self._tables()

    @classmethod
    def from_sentencepiece(cls, path: str) -> Vocabulary:
        """Lower-case pieces. A pair-merge vocabulary's score is minus a rank, a unigram vocabulary's a log probability;
        ranks weigh by Zipf's law."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        score: dict[bytes, float] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) or sp.get_score(i) < -1e8:
                continue
            b = sp.id_to_piece(i).replace("▁", " ").encode("utf-8")
            if START not in b[1:] and b == b.lower():
                score[b] = sp.get_score(i)
        ranks = bool(score) and min(score.values()) < -1000
        weight = {b: 1 / (10.0 - s) if ranks else float(np.exp(s)) for b, s in score.items()}
        least = min(weight.values(), default=1.0) / 10
        for x in range(256):
            weight.setdefault(bytes([x]), least)
        pieces = sorted(weight)
        w = np.array([weight[b] for b in pieces])
        return cls(pieces, np.log(w / w.sum()))

    def _tables(self) -> None:
        """Three tables of 2^19 slots, a piece in the first whose slot was free, and a bit for each longer beginning of a piece."""
        key = np.zeros(len(self.pieces), np.uint64)
        self.longer = np.zeros(1 << 20, bool)
        for i, b in enumerate(self.pieces):
            h = 0
            for at, x in enumerate(b):
                h = (h * int(MULT) + x + 1) & 0xFFFFFFFFFFFFFFFF
                if at < len(b) - 1:
                    self.longer[(h * int(SLOTS[1]) & 0xFFFFFFFFFFFFFFFF) >> 44] = True
            key[i] = h
        self.key = key
        self.slot = [np.full(1 << 19, -1, np.int32) for _ in SLOTS]
        for i, h in enumerate(key):
            for m, t in zip(SLOTS, self.slot):
                s = (int(h) * int(m) & 0xFFFFFFFFFFFFFFFF) >> 45
                if t[s] < 0:
                    t[s] = i
                    break
            else:
                raise ValueError("pieces collide")
        self.taken = self.slot[0] >= 0  # no piece has a hash whose slot is free here

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = np.full(h.shape, -1, np.int32)
        for m, t in zip(SLOTS, self.slot):
            c = t[(h * m) >> np.uint64(45)]
            out = np.where((c >= 0) & (self.key[c] == h), c, out)
        return out

    def arcs(self, x: np.ndarray, logp: np.ndarray, kind: np.ndarray | None = None, log: bool = True) -> list[list[tuple]]:
        """For words of one length as rows of bytes: by piece length and start, the rows that have a piece there, the piece and its weight.

        logp is (kinds, pieces) where kind names each row's, else (pieces,). A start is followed only while some longer
        piece begins so.
        """
        v = np.ascontiguousarray(x.T).astype(np.uint64) + np.uint64(1)
        n, m = v.shape
        flat = logp.ravel() if log else np.exp(logp.ravel())
        base = np.zeros(m, np.int64) if kind is None else kind.astype(np.int64) * logp.shape[-1]
        at, row, h = np.repeat(np.arange(n), m), np.tile(np.arange(m), n), v.ravel()
        out = []
        for l in range(1, min(self.longest, n) + 1):
            near = np.flatnonzero(self.taken[(h * SLOTS[0]) >> np.uint64(45)])
            piece = self.find(h[near])
            is_, piece = near[piece >= 0], piece[piece >= 0].astype(np.int64)
            r = row[is_]
            weight, cut = flat[base[r] + piece], np.searchsorted(at[is_], np.arange(n - l + 2))
            out.append([(r[i:j], piece[i:j], weight[i:j]) for i, j in zip(cut[:-1], cut[1:])])
            go = np.flatnonzero((at < n - l) & self.longer[(h * SLOTS[1]) >> np.uint64(44)])
            at, row = at[go], row[go]
            h = h[go] * MULT + v[at + l, row]
        return out

    def forward(self, arcs: list[list[tuple]], n: int, m: int) -> np.ndarray:
        """(n + 1, words) log of the total weight of all segmentations of each beginning."""
        a = np.full((n + 1, m), -np.inf)
        a[0] = 0
        for j in range(1, n + 1):
            for l in range(1, min(len(arcs), j) + 1):
                r, _, w = arcs[l - 1][j - l]
                if len(r):
                    a[j, r] = np.logaddexp(a[j, r], a[j - l, r] + w)
        return a

    def expected(self, x: np.ndarray, count: np.ndarray, logp: np.ndarray, kind: np.ndarray | None = None) -> np.ndarray:
        """Expected uses of each piece in words x that occur count times; with kind, one after another for each kind."""
        n, m = x.shape[1], len(x)
        size = logp.shape[-1]
        base = np.zeros(m, np.int64) if kind is None else kind.astype(np.int64) * size
        log = n > PLAIN  # short words cannot underflow and need no logarithms
        arcs = self.arcs(x, logp, kind, log)
        if log:
            a, b = self.forward(arcs, n, m), np.full((n + 1, m), -np.inf)
            b[n] = 0
        else:
            a, b = np.zeros((n + 1, m)), np.zeros((n + 1, m))
            a[0], b[n] = 1, 1
            for j in range(1, n + 1):
                for l in range(1, min(len(arcs), j) + 1):
                    r, _, w = arcs[l - 1][j - l]
                    a[j, r] += a[j - l, r] * w
        pieces, shares = [], []
        for i in range(n - 1, -1, -1):
            for l in range(1, min(len(arcs), n - i) + 1):
                r, piece, w = arcs[l - 1][i]
                if not len(r):
                    continue
                if log:
                    out = w + b[i + l, r]
                    b[i, r] = np.logaddexp(b[i, r], out)
                    share = np.exp(np.minimum(0.0, a[i, r] + out - a[n, r]))
                else:
                    out = w * b[i + l, r]
                    b[i, r] += out
                    share = a[i, r] * out / a[n, r]
                pieces.append(base[r] + piece)
                shares.append(share * count[r])
        return np.bincount(np.concatenate(pieces), np.concatenate(shares), logp.size)

    def by_length(self, words: list[bytes], most_cells: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, bytes) of words of one length each, with the opening space, in blocks of bounded size."""
        size = np.array([len(w) for w in words])
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            n = int(size[order[at]])
            end = min(int(np.searchsorted(size[order], n, side="right")), at + max(1, most_cells // (n + 1)))
            pick = order[at:end]
            x = np.full((len(pick), n + 1), START, np.uint8)
            x[:, 1:] = np.frombuffer(b"".join(words[i] for i in pick), np.uint8).reshape(len(pick), n)
            yield pick, x
            at = end

    def log_words(self, words: list[bytes], logp: np.ndarray, kind: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each word among all words, of its kind.

        A word ends where the next piece opens one, so with piece probabilities that add up to 1, and A of them on
        pieces that open a word, the words' marginals add up to A / (1 - (1 - A)) = 1.
        """
        out = np.empty(len(words))
        for pick, x in self.by_length(words):
            out[pick] = self.forward(self.arcs(x, logp, None if kind is None else kind[pick]), x.shape[1], len(x))[-1]
        return out


def _pack(a: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


CHUNK = "chunk long, z int, words array<binary>, h1 array<long>, h2 array<long>, counts array<long>, doc_id array<long>, held_out array<boolean>, ends array<long>, places binary, times binary"
DIM = 512
DOCS = 500  # documents of a chunk whose numbers are added up at once
GRID = [(a / 20, b) for a in range(20) for b in (0.0, 0.01, 0.03, 0.1, 0.3, 0.6) if a / 20 + b < 0.995]  # shares of the own and of all clusters' counts


def pair_counts(raw: bytes) -> np.ndarray:
    """Hashed counts of adjacent bytes."""
    b = np.frombuffer(raw, np.uint8).astype(np.int32)
    return np.bincount((b[:-1] * 37 + b[1:]) % DIM, minlength=DIM)


def byte_pairs(raw: bytes) -> np.ndarray:
    """A unit vector of hashed counts of adjacent bytes; zero for fewer than two bytes."""
    v = np.sqrt(pair_counts(raw))
    return v / (np.linalg.norm(v) or 1.0)


def _counted(batches: Iterator[pd.DataFrame], block: int = 1000) -> Iterator[pd.DataFrame]:
    """The pair counts of blocks of texts, exact and packed; texts without pairs are left out."""
    for b in batches:
        texts = b["text"].tolist()
        for at in range(0, len(texts), block):
            c = np.array([pair_counts((t or "").encode("utf-8", "surrogatepass")) for t in texts[at : at + block]], np.uint32)
            yield pd.DataFrame({"pairs": [_pack(c[c.any(axis=1)].ravel())]})


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """Unit vectors of each block that has any."""
    for b in batches:
        for p in b["pairs"]:
            v = np.sqrt(_unpack(p, np.uint32).reshape(-1, DIM).astype(float))
            if len(v):
                yield v / np.linalg.norm(v, axis=1, keepdims=True)


UNIT = 1 << 30  # sums are of whole numbers, so they do not depend on how the rows are dealt


def _sums(pairs: DataFrame, c: np.ndarray) -> np.ndarray:
    """(centers, DIM) sum of the vectors nearest each center."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(c.shape, np.int64)
        for v in _vectors(batches):
            own = (v @ c.T).argmax(axis=1)
            for j in np.unique(own):
                total[j] += np.rint(v[own == j] * UNIT).astype(np.int64).sum(axis=0)
        z, cell = np.nonzero(total)
        yield pd.DataFrame({"z": z, "cell": cell, "v": total[z, cell]})

    out = np.zeros(c.shape)
    for r in pairs.mapInPandas(add, "z long, cell long, v long").groupBy("z", "cell").agg(F.sum("v").alias("v")).collect():
        out[r.z, r.cell] = r.v / UNIT
    return out


def _farthest(pairs: DataFrame, c: np.ndarray) -> np.ndarray:
    """The vector least like the center it is most like."""

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for v in _vectors(batches):
            like = np.round((v @ c.T).max(axis=1), 9)
            for i in np.flatnonzero(like == like.min()):
                if best is None or (like[i], tuple(v[i])) < best:
                    best = like[i], tuple(v[i])
        if best is not None:
            yield pd.DataFrame({"like": [best[0]], "v": [np.array(best[1])]})

    found = pairs.mapInPandas(least, "like double, v array<double>").agg(F.min(F.struct("like", "v")).alias("b")).first().b
    return np.zeros(DIM) if found is None else np.array(found.v)


def centers(pairs: DataFrame, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of all vectors; starts are each farthest from those before, the first from the mean."""
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    at = [unit(_sums(pairs, np.zeros((1, DIM)))[0])]
    for _ in range(k):
        at.append(_farthest(pairs, np.array(at)))
    c = np.array(at[1:])
    for _ in range(rounds):
        sums = _sums(pairs, c)
        new = np.array([unit(m) if m.any() else old for m, old in zip(sums, c)])
        if (new == c).all():
            break
        c = new
    return c


def texts_log(log_word: np.ndarray, times: np.ndarray, owner: np.ndarray, n_docs: int, urns: tuple = (500.0, 20.0), most_words: int = 200_000) -> np.ndarray:
    """Natural log probability of each document's words, given each (document, word)'s log probability and count; owner ascends.

    An equal mixture of drawing words independently and of drawing them from urns that start with so many words in
    the model's proportions and get a copy of each word drawn: texts that repeat themselves favour a small urn.
    Documents are taken a block of about `most_words` uses at a time, as an urn needs a number for each use.
    """
    upto = np.concatenate([[0], np.cumsum(times, dtype=np.int64)])
    ends = np.searchsorted(owner, np.arange(n_docs), side="right")
    used, out, first = upto[ends], np.zeros(n_docs), 0
    while first < n_docs:
        lo = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(used, upto[lo] + most_words, side="right")))
        hi = ends[last - 1]
        out[first:last] = _urns_log(log_word[lo:hi], times[lo:hi], owner[lo:hi] - first, last - first, urns)
        first = last
    return out


def _urns_log(log_word: np.ndarray, times: np.ndarray, owner: np.ndarray, n_docs: int, urns: tuple) -> np.ndarray:
    add = lambda v, o=owner: np.bincount(o, v, n_docs) if len(o) else np.zeros(n_docs)
    kinds = [add(times * log_word)]
    starts = np.cumsum(times) - times
    again = np.arange(int(times.sum())) - np.repeat(starts, times)  # 0 at a word's first use in its document
    who, lw = np.repeat(owner, times), np.repeat(log_word, times)
    size = add(times).astype(np.int64)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    by_doc = np.repeat(np.arange(n_docs), size)
    for urn in urns:
        drawn = np.where(again > 0, np.log(np.maximum(urn * np.exp(lw) + again, 1e-300)), np.log(urn) + lw)
        kinds.append(add(drawn, who) - add(np.log(urn + step), by_doc))
    return np.logaddexp.reduce(np.stack(kinds), axis=0) - np.log(len(kinds))


def _gathered(batches: Iterator[pd.DataFrame], rows: int = 60_000) -> Iterator[pd.DataFrame]:
    """Batches of about so many rows: long enough for one step of numpy to be worth its call."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


class _Places(dict):
    """Words in the order they came, each with its place."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Chunk:
    def __init__(self) -> None:
        self.at = _Places()
        self.ids, self.held, self.places, self.times, self.size = [], [], [], [], 0

    def add(self, doc_id, held: bool, raw: bytes) -> None:
        words = raw.lower().split()
        u, n = np.unique(np.fromiter(map(self.at.__getitem__, words), np.int32, len(words)), return_counts=True)
        self.ids.append(None if pd.isna(doc_id) else int(doc_id))
        self.held.append(bool(held))
        self.places.append(u)
        self.times.append(n.astype(np.int32))
        self.size += len(raw)

    def row(self, chunk: int, z: int) -> pd.DataFrame:
        n = [len(x) for x in self.places]
        p, t = np.concatenate(self.places), np.concatenate(self.times)
        self.places, self.times = [], []
        use = np.repeat(~np.array(self.held, bool), n)
        train = np.bincount(p[use], t[use], len(self.at)).astype(np.int64)
        keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.at)), np.int64).reshape(len(self.at), 2)
        return pd.DataFrame([{"chunk": chunk, "z": z, "words": list(self.at), "h1": keys[:, 0], "h2": keys[:, 1], "counts": train, "doc_id": self.ids, "held_out": self.held, "ends": np.cumsum(n), "places": _pack(p), "times": _pack(t)}])


def _chunks(batches: Iterator[pd.DataFrame], chunk_bytes: int, middle: np.ndarray) -> Iterator[pd.DataFrame]:
    """A row for each chunk of one cluster's documents; all open ones together hold twice chunk_bytes of text at the most, and one document."""
    first = TaskContext.get().partitionId() << 24
    made, open_, size = 0, {}, 0
    for batch in batches:
        for doc_id, held, text in zip(batch["doc_id"].astype(object), batch["held_out"], batch["text"]):
            raw = (text or "").encode("utf-8", "surrogatepass")
            z = int((middle @ byte_pairs(raw)).argmax())
            chunk = open_.setdefault(z, _Chunk())
            chunk.add(doc_id, held, raw)
            size += len(raw)
            if chunk.size >= chunk_bytes or size >= 2 * chunk_bytes:
                full = max(open_, key=lambda k: open_[k].size)
                size -= open_[full].size
                yield open_.pop(full).row(first + made, full)
                made += 1
    for z, chunk in open_.items():
        yield chunk.row(first + made, z)
        made += 1


def score(docs: DataFrame, vocabulary: str, rounds: int = 2, clusters: int = 6, chunk_bytes: int = 24 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score of every row of docs.

    Learns from rows whose crc32 of the id, modulo 5, is not 1. base_score and score are log10 probabilities of the
    whole text: of a unigram word model with 0.5 added to each count, and of the mixture of the lattice with word counts
    and urns; lattice_score is that of the lattice alone, the marginal over all segmentations. Both are those of the
    document's cluster. Clusters and all counts cover every training row. A
    null text is empty: its one token is the end. Without any training row all probabilities come from the
    vocabulary's own scores. Repeated rows and a null id count as documents of their own. The driver keeps cluster
    centers and piece probabilities only, as many as the vocabulary has times clusters; other columns of docs are ignored.
    """
    spark = docs.sparkSession
    voc = Vocabulary.from_sentencepiece(vocabulary)
    shared = spark.sparkContext.broadcast((voc.pieces, voc.logp))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold(F.col("doc_id"), 5) == 1).alias("held_out"))
    pairs = saved(rows.filter(~F.col("held_out")).select("text").mapInPandas(_counted, "pairs binary"), "pairs")
    middle = centers(pairs, clusters)
    chunks = saved(rows.mapInPandas(lambda it: _chunks(it, chunk_bytes, middle), CHUNK), "chunks")
    zs = range(clusters)
    entries = chunks.select("chunk", "z", F.posexplode(F.arrays_zip("h1", "h2", "words", "counts")).alias("place", "w"))
    by_z = [F.sum(F.when(F.col("z") == k, F.col("w.counts")).otherwise(0)).alias(f"c{k}") for k in zs]
    met = F.bit_or(F.expr("shiftleft(1, z)")).alias("met")  # the clusters whose texts use the word, held-out ones included
    words = entries.select("z", "w", F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2")).repartition("h1").groupBy("h1", "h2").agg(F.any_value("w.words").alias("word"), met, *by_z)
    words = saved(words.withColumn("total", sum(F.col(f"c{k}") for k in zs)), "words")
    seen = words.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.count_if(F.col("total") > 0).alias("v"), *[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"n{k}") for k in zs]).first()
    n_z, docs_z = np.array([float(seen[f"n{k}"]) for k in zs]), np.zeros(clusters)
    for r in chunks.select("z", F.explode("held_out").alias("h")).groupBy("z").agg(F.count_if(~F.col("h")).alias("n")).collect():
        docs_z[r.z] = r.n
    docs_in = int(docs_z.sum())
    n_words, n_all, v_all = seen.n, seen.n + docs_in, seen.v + (docs_in > 0)

    logp = np.tile(voc.logp, (clusters, 1))
    for _ in range(rounds if n_words else 0):
        now = logp

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            v = Vocabulary(*shared.value)
            total = np.zeros(now.size)
            for b in _gathered(batches):
                count = b[[f"c{z}" for z in zs]].to_numpy(float)
                at, kind = np.nonzero(count)
                ws = b["word"].to_numpy()[at].tolist()
                for pick, x in v.by_length(ws):
                    total += v.expected(x, count[at[pick], kind[pick]], now, kind[pick])
            z, used = np.nonzero(total.reshape(now.shape))
            yield pd.DataFrame({"z": z, "piece": used, "uses": total.reshape(now.shape)[z, used]})

        uses = np.tile(np.exp(voc.logp), (clusters, 1))  # one use in all, spread by the vocabulary's own scores
        for r in words.filter("total > 0").select("word", *[f"c{k}" for k in zs]).mapInPandas(expect, "z long, piece long, uses double").groupBy("z", "piece").agg(F.sum("uses").alias("uses")).collect():
            uses[r.z, r.piece] += r.uses
        logp = np.log(uses / uses.sum(axis=1, keepdims=True))

    final = logp

    def log_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = Vocabulary(*shared.value)
        for b in _gathered(batches):
            at, kind = np.nonzero(b["met"].to_numpy()[:, None] >> np.array(zs) & 1)
            out = np.zeros((len(b), clusters))
            out[at, kind] = v.log_words(b["word"].to_numpy()[at].tolist(), final, kind)
            yield b.drop(columns=["word"]).assign(**{f"m{z}": out[:, z] for z in zs})

    numbers = ["h1", "h2", "met", *[f"c{k}" for k in zs], "total"]
    kept = ", ".join(f"{c} {'int' if c == 'met' else 'long'}" for c in numbers)
    scored = saved(words.select("word", *numbers).mapInPandas(log_words, f"{kept}, " + ", ".join(f"m{k} double" for k in zs)), "scored")
    share = np.zeros((clusters, 2))
    if n_words > 1:
        sizes = F.element_at(F.array(*[F.lit(float(max(1, n - 1))) for n in n_z]), F.col("x.z") + 1)
        each = scored.select("total", F.explode(F.array(*[F.struct(F.lit(k).alias("z"), F.col(f"c{k}").alias("c"), F.col(f"m{k}").alias("m")) for k in zs])).alias("x")).filter("x.c > 0")
        one_out = each.select("x.z", "x.c", F.greatest(F.exp("x.m"), F.lit(1e-300)).alias("m"), ((F.col("x.c") - 1) / sizes).alias("own"), ((F.col("total") - 1) / (n_words - 1)).alias("all"))
        for r in one_out.groupBy("z").agg(*[F.sum(F.col("c") * F.log(F.lit(a) * F.col("own") + F.lit(b) * F.col("all") + F.lit(1 - a - b) * F.col("m"))).alias(f"g{i}") for i, (a, b) in enumerate(GRID)]).collect():
            share[r.z] = GRID[int(np.argmax([r[f"g{i}"] for i in range(len(GRID))]))]
    end = (docs_z + 1) / (n_z + docs_z + 2)
    log_z = np.log10((docs_z + 1) / (docs_in + clusters))

    def finish(key, chunk: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        row = chunk.iloc[0]
        z, n_docs = int(row["z"]), len(row["doc_id"])
        own, total, log_piece = np.zeros(len(got)), np.zeros(len(got)), np.zeros(len(got))
        at = got["place"].to_numpy(np.int64)
        own[at], total[at], log_piece[at] = got["c"], got["total"], got["log_piece"]
        a, b = share[z]
        with np.errstate(divide="ignore"):
            whole = np.log(a * own / max(n_z[z], 1) + b * total / max(n_words, 1))
        lm = np.logaddexp(whole, np.log(1 - a - b) + log_piece)
        base = np.log10((total + 0.5) / (n_all + 0.5 * (v_all + 1)))
        place, times = _unpack(row["places"], np.int32), _unpack(row["times"], np.int32)
        cut = np.concatenate([[0], row["ends"]]).astype(int)
        found = np.zeros((5, n_docs))
        for i in range(0, n_docs, DOCS):
            j, p, t = min(n_docs, i + DOCS), place[cut[i] : cut[min(n_docs, i + DOCS)]], times[cut[i] : cut[min(n_docs, i + DOCS)]]
            owner = np.repeat(np.arange(j - i), np.diff(cut[i : j + 1]))
            add = lambda v: np.bincount(owner, v, j - i) if len(owner) else np.zeros(j - i)  # noqa: B023, E731
            found[:, i:j] = add(t), add(t * (total[p] > 0)), add(t * base[p]), texts_log(lm[p], t, owner, j - i), add(t * log_piece[p])
        n_words_in, known, base_sum, mixed, pieces = found
        ends = np.log1p(-end[z]) * n_words_in + np.log(end[z])
        return pd.DataFrame({
            "doc_id": pd.array(list(row["doc_id"]), dtype="Int64"),
            "held_out": np.array(row["held_out"], bool),
            "n_tokens": n_words_in.astype(np.int64) + 1,
            "n_known": known.astype(np.int64) + int(docs_in > 0),
            "train_tokens": np.full(n_docs, n_all, np.int64),
            "base_score": base_sum + np.log10((docs_in + 0.5) / (n_all + 0.5 * (v_all + 1))),
            "score": (mixed + ends) / np.log(10) + log_z[z],
            "lattice_score": (pieces + ends) / np.log(10) + log_z[z],
        })

    of_z = lambda name: F.element_at(F.array(*[F.col(f"{name}{k}") for k in zs]), F.col("z") + 1)
    places = entries.select("chunk", "z", "place", F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))
    back = places.join(scored.hint("shuffle_hash"), ["h1", "h2"]).select(F.col("chunk").alias("of_chunk"), "place", of_z("c").alias("c"), "total", of_z("m").alias("log_piece"))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"
    return chunks.select("chunk", "z", "doc_id", "held_out", "ends", "places", "times").groupBy("chunk").cogroup(back.groupBy("of_chunk")).applyInPandas(finish, out)

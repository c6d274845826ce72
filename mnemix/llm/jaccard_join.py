"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Every text is the set of its five-word shingles. Each tree of the forest is a trie over signatures of MinHash values of
its own; a node is a prefix, and texts under one node are candidates. How long a prefix must be is chosen for each text
and tree: from the full signature it is shortened until the chance that a pair at the threshold shares a node in at
least one tree reaches the target recall, whatever the data; and one value further wherever the node above is still
small, so that texts with few relatives are compared with all of them and only crowded nodes keep the longer prefix.
Candidate groups are verified exactly on whole shingle sets. A large group is cut into blocks and every pair of blocks is
one small task, which counts its links in place: what leaves a task is one row a text, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemix.llm.common import components, looked_up, saved

N = 5
C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
SIG = "doc_id long, k1 long, k2 long, n int, upper array<long>, lower array<long>"


class _Words(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) > 300_000:
            self.clear()
        self[word] = h
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of one to four words is one shingle, one without words none."""
    w = (text or "").encode("utf-8", "surrogatepass").split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    if len(w) < N:
        s = np.array([len(w)], np.uint64) + (h * C[: len(h)]).sum(dtype=np.uint64)
    else:
        s = h[: len(h) - N + 1] * C[0]
        for j in range(1, N):
            s = s + h[j : len(h) - N + 1 + j] * C[j]
    return np.unique(_mix(s))


def depth(trees: int, longest: int, threshold: float, recall: float) -> int:
    """The longest prefix with which a pair at the threshold meets in some tree with at least the wanted chance."""
    d = longest
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def _signatures(batches: Iterator[pd.DataFrame], trees: int, d: int) -> Iterator[pd.DataFrame]:
    r = np.random.default_rng(5)
    a = r.integers(0, 1 << 63, trees * d, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    x = r.integers(0, 1 << 63, trees * d, dtype=np.uint64)
    tree = np.arange(trees, dtype=np.uint64) + np.uint64(1)
    words = _Words()
    for batch in batches:
        ids, texts = batch["doc_id"].to_numpy(), batch["text"].tolist()
        at = 0
        while at < len(texts):
            sets, size, first = [], 0, at
            while at < len(texts) and size < 150_000:
                sets.append(shingles(texts[at], words))
                size += len(sets[-1])
                at += 1
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            upper, lower = (np.zeros((len(sets), trees), np.uint64) for _ in range(2))
            if len(full):
                u = np.concatenate([sets[i] for i in full])
                starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                low = np.stack([np.minimum.reduceat((u ^ x[k]) * a[k], starts) for k in range(trees * d)], axis=1).reshape(len(full), trees, d)
                p = np.zeros((len(full), trees), np.uint64)
                for j in range(d):
                    if j == d - 1:
                        upper[full] = _mix(p + tree * C[1])
                    p = _mix(p + low[:, :, j] + C[j % N])
                lower[full] = _mix(p + tree * C[0])
            keys = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            yield pd.DataFrame({
                "doc_id": ids[first:at],
                "k1": np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64).view(np.int64),
                "k2": np.array([k >> 64 for k in keys], np.uint64).view(np.int64),
                "n": n.astype(np.int32),
                "upper": list(upper.view(np.int64)),
                "lower": list(lower.view(np.int64)),
            })


SET = "bucket long, i int, j int, rep long, side int, copies long, smaller binary, shingles binary"


def _sets(batches: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """One row for each pair of blocks a text takes part in."""
    words, seen = _Words(), set()
    names = [f.split()[0] for f in SET.split(", ")]
    for batch in batches:
        rows, held = [], 0
        for rep, k2, copies, keys, sizes, text in zip(batch["k1"], batch["k2"], batch["copies"], batch["keys"], batch["sizes"], batch["text"]):
            if rep in seen:
                continue  # a repeated row
            k1, s = rep, shingles(text, words)
            k = xxhash.xxh3_128_intdigest(s.tobytes())
            if np.array([k & 0xFFFFFFFFFFFFFFFF, k >> 64], np.uint64).view(np.int64).tolist() != [k1, k2]:
                continue  # another text of the same id
            if len(seen) > 1_000_000:
                seen.clear()
            seen.add(rep)
            raw, order = s.tobytes(), np.argsort(keys)
            keys = np.asarray(keys, np.int64)[order]
            for at, (key, size) in enumerate(zip(keys.tolist(), np.asarray(sizes)[order].tolist())):
                parts = -(-size // block)
                own = xxhash.xxh3_64_intdigest(int(rep).to_bytes(8, "little", signed=True), key & 0xFFFFFFFF) % parts
                for other in range(parts):
                    rows.append((key, min(own, other), max(own, other), rep, own, copies, keys[:at].tobytes(), raw))
                    held += len(raw)
                if held > 32 << 20:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)


def shared_counts(sets: list[np.ndarray], cells: int = 4 << 20) -> np.ndarray:
    """How many members each pair of sets shares: products of 0/1 matrices over the members that two sets have."""
    n = len(sets)
    if n <= 4:
        out = np.zeros((n, n))
        for i in range(n):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    u, inv, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = np.cumsum(times > 1) - 1
    used = (times > 1)[inv]
    row, col = np.repeat(np.arange(n), [len(s) for s in sets])[used], keep[inv[used]]
    out, width = np.zeros((n, n), np.float32), max(1, cells // n)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, [at, at + width])
        m = np.zeros((n, min(width, int(col[-1]) + 1 - at)), np.float32)
        m[row[lo:hi], col[lo:hi] - at] = 1
        out += m @ m.T
    return out


def _verify(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """rep, root, links of the texts of one pair of blocks that have a similar one in it.

    A pair that shares several prefixes is counted under the smallest of them only; root is the smallest text key a text is
    connected with inside the group.
    """
    g = group.drop_duplicates("rep")
    i, j = g["i"].iloc[0], g["j"].iloc[0]
    sets = [np.frombuffer(b, np.uint64) for b in g["shingles"]]
    size = np.array([len(s) for s in sets], float)
    both = shared_counts(sets).astype(float)
    alike = both / np.maximum(size[:, None] + size[None] - both, 1) >= threshold
    np.fill_diagonal(alike, False)
    side = g["side"].to_numpy()
    if i != j:
        alike &= side[:, None] != side[None]
    counted = alike.copy()
    smaller = [np.frombuffer(b, np.int64) for b in g["smaller"]]
    owner, keys = np.repeat(np.arange(len(g)), [len(s) for s in smaller]), np.concatenate(smaller)
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for who in np.split(owner[order], cuts):
        if len(who) > 1:
            counted[np.ix_(who, who)] = False
    links = counted @ g["copies"].to_numpy(float)
    ids = g["rep"].to_numpy()
    root, left = ids.copy(), alike.any(axis=1)
    while True:
        low = np.where(left, np.minimum(root, np.where(alike, root[None], np.iinfo(np.int64).max).min(axis=1)), root)
        if (low == root).all():
            break
        root = low
    return pd.DataFrame({"rep": ids[left], "root": root[left], "links": links[left].astype(np.int64)})


def _grouped(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Groups of a sorted partition, one at a time."""
    held: list[pd.DataFrame] = []
    last = None

    def done() -> pd.DataFrame:
        return _verify(pd.concat(held) if len(held) > 1 else held[0], threshold)

    for batch in batches:
        k = batch[["bucket", "i", "j"]].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(k, axis=0) != 0).any(axis=1)) + 1, [len(k)]])
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            if held and last != tuple(k[lo]):
                out.append(done())
                held = []
            last = tuple(k[lo])
            held.append(batch.iloc[lo:hi])
        if out := [x for x in out if len(x)]:
            yield pd.concat(out)
    if held:
        yield done()


def nodes(reps: DataFrame, small: int) -> DataFrame:
    """(tid, bucket): the node of each tree in which a text is compared, of those that another text is under, too.

    upper and lower are a tree's nodes one value above and at the length that reaches the target recall. A pair that
    shares a lower node shares the upper one, and both texts see the same size of it, so they always agree on the node.
    """
    under = reps.select(F.col("k1").alias("tid"), F.explode(F.arrays_zip("upper", "lower")).alias("t")).select("tid", "t.upper", "t.lower")
    held = under.groupBy("upper").agg(F.count("*").alias("n")).filter("n > 1")
    return under.join(held, "upper").select("tid", F.when(F.col("n") <= small, F.col("upper")).otherwise(F.col("lower")).alias("bucket"))


def classes(docs: DataFrame, threshold: float = 0.8, trees: int = 24, longest: int = 8, recall: float = 0.9999, block: int = 256, small: int = 16) -> DataFrame:
    """doc_id, n (shingles), k1, k2 (the text's shingle set), class_id, n_links of every row of docs; see join()."""
    d = depth(trees, longest, threshold, recall)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    some = rows.filter(F.col("doc_id").isNotNull())
    sig = saved(some.mapInPandas(lambda it: _signatures(it, trees, d), SIG), "signatures")
    reps = sig.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("upper").alias("upper"), F.any_value("lower").alias("lower"))
    reps = saved(reps, "texts")
    # a text goes by k1: an id may stand for several texts, so it cannot name one
    under = saved(nodes(reps, small), "nodes")
    sizes = under.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("tid")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "tid")).alias("x2")).filter("size > 1")
    one_of_equal = sizes.groupBy("size", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    takes = under.join(one_of_equal, "bucket").groupBy("tid").agg(F.collect_list(F.struct("bucket", "size")).alias("b"))
    takes = takes.select("tid", F.col("b.bucket").alias("keys"), F.col("b.size").alias("sizes")).join(reps.select(F.col("k1").alias("tid"), "k1", "k2", "rep", "copies"), "tid")
    texts = takes.join(some, F.col("rep") == F.col("doc_id")).select("k1", "k2", "copies", "keys", "sizes", "text")
    sets = texts.mapInPandas(lambda it: _sets(it, block), SET).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = saved(sets.mapInPandas(lambda it: _grouped(it, threshold), "rep long, root long, links long"), "links")
    roots = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    linked = saved(reps.select(F.col("k1").alias("node"), "rep").join(roots, "node"), "linked")
    first = linked.groupBy("root").agg(F.min("rep").alias("class"))
    named = looked_up(linked, first, ["root"], "inner").select(F.col("node").alias("k1"), "class")
    links = found.groupBy(F.col("rep").alias("k1")).agg(F.sum("links").alias("links"))
    about = reps.select("k1", "k2", "rep", "copies").join(links, "k1", "left").join(named, "k1", "left")
    about = saved(about.select("k1", "k2", F.coalesce("class", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "about")
    worded = looked_up(sig.filter("n > 0").select("doc_id", "n", "k1", "k2"), about, ["k1", "k2"], "inner").select("doc_id", "n", "k1", "k2", "class_id", "n_links")
    bare = sig.filter("n = 0").select("doc_id", "n", "k1", "k2", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return worded.unionByName(bare)


def join(docs: DataFrame, threshold: float = 0.8, trees: int = 24, longest: int = 8, recall: float = 0.9999, block: int = 256, small: int = 16) -> DataFrame:
    """doc_id, class_id, n_links of every row of docs.

    n_links is the number of other rows whose shingle sets are at least `threshold` similar (Jaccard); class_id is the
    smallest id that links lead to, directly or over others, so a text without links is its own class. Texts of one
    shingle set are copies: they stand in the join as one, and count one another as links. Null and empty texts, and
    texts of white space, have no shingles and no links. A row without an id takes no part: its class is null. Rows
    that repeat an id with another text are texts of their own, each with its own links. Other columns are ignored.
    """
    found = classes(docs, threshold, trees, longest, recall, block, small).select("doc_id", "class_id", "n_links")
    none = docs.filter(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(none)

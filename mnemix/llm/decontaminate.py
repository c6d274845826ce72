"""Benchmark decontamination: spaced-seed hashing, as DataFrame expressions only.

A mask fixes some positions of a window of words and ignores the others, so two windows that differ in an ignored word
hash alike. Every window of every benchmark item and of every document is hashed under each mask; equal hashes are
hits, and a hit fixes how item and document align. Along that alignment their words are compared one by one: the
document overlaps the item where a run of `least` words (or the whole item, if shorter) has enough equal words. The
masks are chosen for the lengths of run that the items have, so that every choice of differing words which leaves
enough equal ones leaves a hit.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemix.llm.common import saved

SHORTEST = 4  # items of fewer words are common turns of phrase: they are looked for as whole texts only
SEED_LIMIT = 1_000_000  # 16 bytes each: the bound under which benchmark seeds are broadcast


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-case words of a text: runs of letters, marks and digits."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _hit(mask: str, n: int) -> list[frozenset[int]]:
    """The positions that each placing of a mask in a run of n words fixes."""
    return [frozenset(i + j for j, c in enumerate(mask) if c == "1") for i in range(n - len(mask) + 1)]


def _masks_of(weight: int, n: int) -> list[str]:
    """All masks of a weight that fit a run of n words, short ones first."""
    if weight == 1:
        return ["1"]
    spans = ((size, inner) for size in range(weight, n + 1) for inner in combinations(range(1, size - 1), weight - 2))
    return ["".join("1" if i in (0, size - 1, *inner) else "0" for i in range(size)) for size, inner in spans]


@lru_cache(maxsize=64)
def masks_for(runs: tuple[tuple[int, int], ...]) -> dict[tuple[int, int], tuple[str, ...]]:
    """For each (words, words that may differ) of a run: masks of which one hits whichever words differ.

    Long runs come first and their masks serve shorter ones too. Masks are as heavy as three more of them allow; below
    a weight of four more are taken instead. A run of more than 13 words holds one of 13 with its share of the differing
    words at most, and is looked for by that.
    """
    out, chosen = {}, []
    for n, differ in sorted(runs, reverse=True):
        part = min(n, 13)
        d = min(differ // (n // part), part - 1)
        patterns = [frozenset(p) for p in combinations(range(part), d)]
        covers = lambda m, left: {p for p in left if any(not p & at for at in _hit(m, part))}  # noqa: E731, B023
        mine, left = [], set(patterns)
        for m in chosen:
            if got := covers(m, left):
                mine.append(m)
                left -= got
        for weight in range(part - d, 0, -1):
            open_, more = set(left), []
            each = {m: covers(m, left) for m in _masks_of(weight, part)} if left else {}
            while open_:
                best = max(each, key=lambda m: len(each[m] & open_))  # noqa: B023
                more.append(best)
                open_ -= each[best]
            if len(more) <= 3 or weight <= SHORTEST:
                break
        chosen += more
        out[n, differ] = (*mine, *more)
    return out


def _seeds(h: Column, masks: list[str]) -> Column:
    """For an array of word hashes: for each window start an array of one hash a mask, null where the mask does not fit."""
    least = min(map(len, masks))

    def at(words: Column) -> Column:
        n = F.size(words)

        def window(i: Column) -> Column:
            each = []
            for k, m in enumerate(masks):
                seed = F.xxhash64(F.lit(k), *[F.get(words, i + j) for j, c in enumerate(m) if c == "1"])
                each.append(seed if len(m) == least else F.when(i + len(m) <= n, seed))
            return F.array(*each)

        return F.when(n >= least, F.transform(F.sequence(F.lit(0), n - least), window))

    # bound once by the outer lambda: the hashes are not computed anew for each window
    return F.get(F.transform(F.array(h), at), F.lit(0))


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.8, seed_limit: int = SEED_LIMIT) -> DataFrame:
    """(doc_id, item_id, at_word, n_words, n_equal): where a document overlaps an item, at its best alignment.

    at_word is where in the document the item's first word would lie; n_words is the length of the compared run
    (`least`, or the item's length if shorter), n_equal the most equal words in such a run; at least share of them are
    equal, whichever they are. Items of one to three words, which clean documents hold by chance, overlap a document that
    is nothing else. Null and empty texts have no words. A null item_id
    is a value like others; documents without an id are reported under a null id. Repeated rows give one result; an
    empty table on either side gives none. Seeds of the benchmark are broadcast only where their number is within
    seed_limit; beyond it the join shuffles both sides.
    """
    items = saved(benchmark.select("item_id", word_hashes(F.col("text")).alias("words")).distinct(), "items")
    run = F.least(F.size("words"), F.lit(least))
    lengths = [r.n for r in items.filter(F.size("words") >= SHORTEST).select(run.alias("n")).distinct().collect()] or [least]
    of_run = {n: m for (n, _), m in masks_for(tuple(sorted((n, n - math.ceil(n * share)) for n in lengths))).items()}
    masks = sorted({m for ms in of_run.values() for m in ms})
    seeds = items.filter(F.size("words") >= SHORTEST).select("item_id", run.alias("run"), F.posexplode(_seeds(F.col("words"), masks)).alias("item_at", "each"))
    seeds = seeds.select("item_id", "run", "item_at", F.posexplode("each").alias("mask", "seed")).filter(F.col("seed").isNotNull())
    # an item is looked for by the masks of its run only
    own = [(F.col("run") == n) & F.col("mask").isin([masks.index(m) for m in ms]) for n, ms in of_run.items()]
    seeds = seeds.filter(reduce(Column.__or__, own)).select("item_id", "item_at", "seed").distinct()
    if seeds.limit(seed_limit + 1).count() <= seed_limit:
        seeds = F.broadcast(seeds)
    found = docs.select("doc_id", F.posexplode(_seeds(word_hashes(F.col("text")), masks)).alias("doc_at", "each")).select("doc_id", "doc_at", F.explode("each").alias("seed"))
    hits = found.join(seeds, "seed").select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    hits = saved(hits, "hits")
    h = hits.withColumnRenamed("doc_id", "h_doc").withColumnRenamed("item_id", "h_item")
    texts = docs.select("doc_id", "text").join(h.select("h_doc").distinct(), F.col("doc_id").eqNullSafe(F.col("h_doc")), "left_semi")
    worded = texts.select("doc_id", word_hashes(F.col("text")).alias("doc_words"))
    pairs = worded.join(h, F.col("doc_id").eqNullSafe(F.col("h_doc"))).join(items.select(F.col("item_id").alias("i_item"), "words"), F.col("h_item").eqNullSafe(F.col("i_item")))
    n = F.size("words")
    equal = F.transform("words", lambda w, j: F.when((j + F.col("shift") >= 0) & (F.get("doc_words", j + F.col("shift")) == w), 1).otherwise(0))
    best = F.array_max(F.transform(F.sequence(F.lit(0), n - run), lambda i: F.aggregate(F.slice(F.col("equal"), i + 1, F.col("n_words")), F.lit(0), lambda a, x: a + x)))
    checked = pairs.select("doc_id", F.col("h_item").alias("item_id"), F.col("shift").cast("long").alias("at_word"), run.alias("n_words"), equal.alias("equal"), "words")
    checked = checked.select("doc_id", "item_id", "at_word", "n_words", best.alias("n_equal")).filter(F.col("n_equal") >= F.ceil(F.col("n_words") * share))
    top = F.max(F.struct("n_equal", (-F.col("at_word")).alias("before"), "n_words")).alias("top")
    brief = items.filter(F.size("words").between(1, SHORTEST - 1)).select("item_id", "words", F.xxhash64("words").alias("key"))
    few = docs.select("doc_id", word_hashes(F.col("text")).alias("doc_words")).filter(F.size("doc_words").between(1, SHORTEST - 1))
    whole = few.withColumn("key", F.xxhash64("doc_words")).join(brief, "key").filter(F.col("doc_words") == F.col("words"))
    n = F.size("words")
    whole = whole.select("doc_id", "item_id", F.lit(0).cast("long").alias("at_word"), n.alias("n_words"), n.alias("n_equal"))
    out = checked.unionByName(whole).groupBy("doc_id", "item_id").agg(top)
    return out.select("doc_id", "item_id", (-F.col("top.before")).alias("at_word"), F.col("top.n_words").alias("n_words"), F.col("top.n_equal").alias("n_equal"))


def clean(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without those that overlap an item."""
    leaked = found.select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["__leaked"]), "left_anti")

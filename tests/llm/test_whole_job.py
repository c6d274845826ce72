"""What the operators find at the edge of their own rules."""

from inspect import signature
from itertools import combinations

import numpy as np
import pandas as pd

from mnemix.llm import decontaminate, lattice_lm


def table(spark, rows, schema):
    return spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]), schema)


def test_masks_hit_every_pattern():
    for alone in [tuple((n, n - -(-n * 4 // 5)) for n in range(4, 14)), *[((n, n - -(-n * 4 // 5)),) for n in range(4, 14)]]:
        for (n, differ), masks in decontaminate.masks_for(alone).items():
            for d in range(differ + 1):
                for p in map(set, combinations(range(n), d)):
                    assert any(all(i + j not in p for j, c in enumerate(m) if c == "1") for m in masks for i in range(n - len(m) + 1))


def test_masks_of_long_runs():
    ((_, masks),) = decontaminate.masks_for(((15, 3),)).items()
    for p in map(set, combinations(range(15), 3)):
        assert any(all(i + j not in p for j, c in enumerate(m) if c == "1") for m in masks for i in range(15 - len(m) + 1))


def test_decontamination_finds_every_pattern(spark):
    sizes = {4: 0, 5: 1, 6: 1, 7: 1, 8: 1, 10: 2, 13: 2, 14: 2}
    bench = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in sizes]
    rows, want = [], set()
    for n, d in sizes.items():
        for p in combinations(range(n), d):
            rows.append((len(rows), "before it " + " ".join(f"other{k}" if k in p else f"i{n}x{k}" for k in range(n)) + " and after"))
            want.add((rows[-1][0], n))
    for n, d in sizes.items():  # one word more than may differ, spread out
        p = [(k * n) // (d + 1) + n // (2 * d + 2) for k in range(d + 1)]
        rows.append((len(rows), " ".join(f"other{k}" if k in p else f"i{n}x{k}" for k in range(n))))
    # the last leaves 13 of 14 words with two that differ
    docs, items = table(spark, rows, "doc_id long, text string"), table(spark, bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, items).collect()}
    assert want <= got
    extra = got - want
    assert all(i == 14 for _, i in extra)


def test_lattice_rounds_and_grid():
    assert signature(lattice_lm.score).parameters["rounds"].default == 2
    assert len({a for a, _ in lattice_lm.GRID}) == 20 and {b for a, b in lattice_lm.GRID if a == 0} == {0.0, 0.01, 0.03, 0.1, 0.3, 0.6}


def test_lattice_clusters_cover_all_texts(spark):
    few = "щука жила в пруду и ела рыбу"
    rows = [(i, f"the cat {i} sat on the mat with {i * 7} dogs" if i % 2500 else few) for i in range(5000)] + [(-1, None), (-2, "a")]
    texts = table(spark, rows, "doc_id long, text string")
    got = [lattice_lm.centers(texts.repartition(n).mapInPandas(lattice_lm._counted, "pairs binary"), 3, rounds=2) for n in (1, 3)]
    assert np.array_equal(got[0], got[1])
    assert (got[0] @ lattice_lm.byte_pairs(few.encode())).max() > 0.99


def test_lattice_alone_is_the_marginal(spark):
    import public_tokenizers

    # one cluster without rounds: the starting weights give the marginal of each word, known or not
    path = public_tokenizers.path("piece_bpe_32k.model")
    voc = lattice_lm.Vocabulary.from_sentencepiece(path)
    rows = [(i, "the old mill by the river " * (1 + i % 3)) for i in range(40)]
    got = lattice_lm.score(table(spark, rows, "doc_id long, text string"), path, rounds=0, clusters=1).collect()
    train = [r for r in got if not r.held_out]
    end = (len(train) + 1) / (sum(r.n_tokens - 1 for r in train) + len(train) + 2)
    for r in got:
        words = rows[r.doc_id][1].encode().split()
        want = voc.log_words(words, voc.logp).sum() + len(words) * np.log1p(-end) + np.log(end)
        assert abs(r.lattice_score - want / np.log(10)) < 1e-6 * abs(want)
        assert r.score > r.lattice_score


def test_texts_log_holds_a_block():
    """An urn has a number for each use of a word: of many documents only a block's are held, and the sums stay the same."""
    import tracemalloc

    rng = np.random.default_rng(0)
    n, each = 3000, 100
    owner, times = np.repeat(np.arange(n), each), rng.integers(1, 12, n * each).astype(np.int32)
    lw = -rng.uniform(1, 15, n * each)
    whole = lattice_lm.texts_log(lw, times, owner, n, most_words=1 << 60)
    tracemalloc.start()
    got = lattice_lm.texts_log(lw, times, owner, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, whole, rtol=1e-12) and peak < 40e6  # all uses at once take over 150 MB
    some = lattice_lm.texts_log(lw[:300], times[:300], np.repeat([0, 2, 5], each), 7)  # documents without words, the first and last included
    assert np.allclose(some[[0, 2, 5]], lattice_lm.texts_log(lw[:300], times[:300], np.repeat([0, 1, 2], each), 3)) and np.allclose(some[[1, 3, 4, 6]], 0)


def test_open_chunks_are_bounded(monkeypatch):
    """Chunks of several clusters are open at once; together they hold no more than twice one chunk's text."""
    monkeypatch.setattr(lattice_lm, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    texts = [chr(97 + i % 6) * 99 + " " for i in range(120)]
    middle = np.array([lattice_lm.byte_pairs(t.encode()) for t in texts[:6]])
    read = []

    def batches():
        for i, t in enumerate(texts):
            read.append(i)
            yield pd.DataFrame({"doc_id": [i], "held_out": [False], "text": [t]})

    ids, seen = [], 0
    for row in lattice_lm._chunks(batches(), 1000, middle):
        ids += row.iloc[0]["doc_id"]
        seen = max(seen, len(read) - len(ids) + len(row.iloc[0]["doc_id"]))
    assert sorted(ids) == list(range(120)) and seen <= 20

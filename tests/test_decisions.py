"""Questions, sequences, grounding and decisions beside the registered queries."""

import pytest
from pyspark.sql import functions as F

from mnemix.operators import deciding as D
from mnemix.operators import questions as Q
from mnemix.operators import scoring as S


@pytest.mark.parametrize(
    "definition",
    [
        [], {"type": "vote", "instructions": "x"}, {"type": "choice", "criteria": ["a"]}, {"type": "choice", "instructions": "x"}, {"type": "choice", "instructions": "x", "criteria": {}},
        {"type": "score", "instructions": "x", "criteria": {"a": 1}}, {"type": "score", "instructions": "x", "criteria": []}, {"type": "noul", "instructions": "x", "criteria": []},
        {"type": "choice", "instructions": "x", "criteria": ["a"], "labels": {"true": "a", "false": "b"}}, {"type": "noul", "instructions": "x", "labels": {"true": "a", "false": " a "}},
        {"type": "noul", "instructions": "x", "labels": {"true": "a"}},
    ],
)
def test_bad_questions(definition):
    with pytest.raises(Q.BadQuestion, match="question 'q'"):
        Q.parse_question("q", definition)


def test_questions_and_labels():
    with pytest.raises(Q.BadQuestion):
        Q.parse_questions([])
    a = Q.parse_question("a", {"type": "choice", "instructions": {"b": 1.0}, "criteria": {"x": None, "y": {"z": [1, 2.5]}}})
    assert a.instructions == '{"b": 1.0}' and a.options == ("x", 'y: {"z": [1, 2.5]}')
    n = Q.parse_question("n", {"type": "noul", "instructions": "?", "criteria": {"True": "sure"}})
    assert n.options == ("false: no, the statement does not hold", "true: sure")
    s = Q.parse_question("s", {"type": "score", "instructions": "?", "criteria": ["low", "high"]})
    assert [Q.label_index(a, "y"), Q.label_index(n, True), Q.label_index(n, "FALSE"), Q.label_index(s, 1)] == [1, 1, 0, 1]
    for q, bad in ((a, "w"), (n, 2), (n, "yes"), (s, 2), (s, True), (s, -1)):
        with pytest.raises(Q.BadQuestion):
            Q.label_index(q, bad)


def test_json_as_python_writes_it():
    assert Q.py_json({"a": [1, 2.0, None, True], "ü": "é\n"}) == '{"a": [1, 2.0, null, true], "ü": "é\\n"}'
    assert [Q.py_float(x) for x in (1e16, 1e-5, 0.1, 100.0, -0.0)] == ["1e+16", "1e-05", "0.1", "100.0", "-0.0"]


def test_grounding():
    assert Q.ground('{"question":"q?"}', "the text", "passage", True) == '{"passage":"the text","question":"q?"}'
    assert Q.ground('{"a":1}', "") == '{"a":1}' and Q.ground("x", "") == "x"
    assert Q.ground('{"a":1,"memory":"old"}', "m") == '{"a":1,"memory":"m"}' and Q.ground("plain [x", "m") == '{"input":"plain [x","memory":"m"}'
    turns = "[" + ",".join('{"role":"user","content":"turn %d"}' % i for i in range(30)) + "]"
    g = Q.json.loads(Q.ground(turns, "refunds take five days"))
    assert len(g) == 31 and g[30]["content"] == "turn 29" and g[29] == {"role": "system", "content": "memory: refunds take five days"}


def test_sequences():
    e = S.WordEncoder()
    ids, places = S.model_sequence(e, "s1 s2 s3", "choice question: which", ["a b", "c"], most=20)
    assert ids[0] == e.cls and [ids[p] for p in places] == [e.mask] * 2 and ids[-1] == e.sep and len(ids) == 1 + 3 + 1 + 3 + 2 + 1 + 3 + 1
    long_ = " ".join(f"w{i}" for i in range(500))
    first, last = (S.model_sequence(e, long_, "h", ["a"], most=50, keep_end=k)[0] for k in (False, True))
    assert len(first) == len(last) == 50 and first[6] == e.encode("w0")[0] and last[-2] == e.encode("w499")[0]
    ids, places = S.model_sequence(e, "", long_, [long_] * 10, most=2000, most_head=100)  # options cut alike, the head keeps sixteen or more
    assert {b - a for a, b in zip(places, places[1:])} == {(100 - 16) // 10} and places[0] == 2 + 100 - 10 * 8
    run = lambda rows: [[float(sum(ids) % 7 + i) for i in range(len(places))] for ids, places in rows]
    got = S.SequenceScorer(e, run).logits([("choice", "i", ["a", "b"], f"state {'x ' * (9 - k)}") for k in range(9)])
    one = [S.SequenceScorer(e, run, batch=1).logits([("choice", "i", ["a", "b"], f"state {'x ' * (9 - k)}")])[0] for k in range(9)]
    assert got == one
    with pytest.raises(ValueError, match="only"):
        S.SequenceScorer(e, run, most=10).logits([("choice", "i", ["a"] * 20, "s")])


def states(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "state_id long, state string")


def test_decide_edges(spark):
    q = Q.parse_questions({"one": {"type": "choice", "instructions": "?", "criteria": ["only"]}, "n": {"type": "noul", "instructions": "?"}})
    d = {(r.state_id, r.qid): r for r in D.decide(states(spark, ["a", "a", None, "", "Привет мир, как дела сегодня"]), q, S.HashScorer()).collect()}
    assert d[0, "one"].confidence == 1.0 and d[0, "one"].answer == "only" and d[1, "n"].cached and not d[0, "n"].cached
    assert d[4, "n"].answer is None and d[4, "n"].handoff and d[4, "n"].strategy == "script_gate"
    assert D.decide(states(spark, []), q, S.HashScorer()).count() == 0
    with pytest.raises(ValueError, match="embedder"):
        D.decide(states(spark, ["a"]), q, S.HashScorer(), D.Options(oos_similarity=0.3))
    with pytest.raises(ValueError, match="pooled"):
        D.context_vectors(states(spark, ["a"]), q, S.SequenceScorer(S.WordEncoder(), None))


def test_tournament_with_union_ends(spark):
    q = Q.parse_questions({"m": {"type": "choice", "instructions": "?", "criteria": [f"o{i}" for i in range(60)]}})
    d = D.decide(states(spark, ["some state", "another"]), q, S.HashScorer(), D.Options(shortlist=16), embedder=S.HashEmbedder()).collect()
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 and 1 < r.rounds <= 8 and set(r.alive) >= {i for i, p in enumerate(r.probabilities) if p > 0} for r in d)


def test_recalled_memory(spark):
    near = spark.createDataFrame([(1, 1, 0, 0.9), (1, 2, 1, 0.8), (1, 3, 1, 0.7), (2, 1, 2, 0.5)], "state_id long, rank int, label int, sim double")
    r = {x.state_id: x for x in D.recalled(near, "q", 3, k=2, temperature=0.1, first=(3, 1.0)).collect()}
    e = 2.718281828459045
    assert abs(r[1].pm[0] - 1 / (1 + e**-1)) < 1e-9 and r[1].votes == [1, 1, 0] and r[2].pm == [0.0, 0.0, 1.0]
    assert abs(r[1].first[1] - (e**-0.1 + e**-0.2) / (1 + e**-0.1 + e**-0.2)) < 1e-9
    q = Q.parse_questions({"q": {"type": "choice", "instructions": "?", "criteria": ["a", "b", "c"]}})
    known = D.Experience(D.recalled(near, "q", 3, k=2, temperature=0.1), {"q": 2.0}, {"q": 0.9})
    got = D.decide(states(spark, ["x", "y", "z"]), q, S.HashScorer(), D.Options(agree_votes=1), known).orderBy("state_id").collect()
    assert [g.strategy for g in got] == ["direct", "votes", "votes"] and got[2].answer == "c"
    assert F is not None


def test_equal_states_of_different_experience_answer_apart(spark):
    q = Q.parse_questions({"topic": {"type": "choice", "instructions": "Which?", "criteria": ["a", "b"]}})
    states = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "x")], "state_id long, state string")
    known = spark.createDataFrame([(2, "topic", [0.9, 0.1], [8, 0], [0.9, 0.1]), (3, "topic", [0.1, 0.9], [0, 8], [0.1, 0.9])], "state_id long, qid string, pm array<double>, votes array<int>, first array<double>")
    got = {r.state_id: (r.answer, r.strategy, r.cached) for r in D.decide(states, q, S.HashScorer(), D.Options(), D.Experience(known)).collect()}
    assert got[2] == ("a", "memory_first", False) and got[3] == ("b", "memory_first", False)
    assert got[1][1:] == ("direct", False) and got[4] == (got[1][0], "direct", True)


def test_an_order_ensemble_reads_its_decisions_once(spark, monkeypatch):
    from mnemix.plans.registry import decisions as P

    d = spark.createDataFrame([(1, "q", "a", 0.5, 0.5, True)], "state_id long, qid string, answer string, value double, confidence double, permuted boolean")
    monkeypatch.setattr(P.D, "decide", lambda *a, **k: d)
    monkeypatch.setattr(P, "states", lambda *a: None)
    got = P.x10_order_ensemble(spark, "")
    assert got.columns == [*d.columns] and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()

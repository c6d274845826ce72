import pytest

from mnemix.engine import Engine

DOCS = [(1, "Refunds need a receipt. The president signs them.", "text", "policy"), (2, "## [ID: Approve_Refund]\n**Action:** Approve\n**Data_Connections:** [Receipt]\n**Context_Links:** [Check_Card]\n", "auto", "kb"), (3, "## [ID: Check_Card]\n**Action:** Check\n**Data_Connections:** [Card]\n", "atf", "kb")]
SCHEMA = "doc_seq long, text string, format string, source string"


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "m"))
    assert e.call("ingest_batch", docs=spark.createDataFrame(DOCS, SCHEMA))["ingested"] == 3
    q = spark.createDataFrame([(1, "receipt"), (2, "recipt"), (3, "zzxqq")], "query_id long, q string")
    got = {r.query_id: r for r in e.query(q).filter("rank = 1").collect()}
    assert (got[1].stage, got[2].stage, got[3].stage) == ("exact", "fuzzy", "hub") and got[3].handoff and all(r.id.startswith("F_") for r in got.values())
    c = {r.query_id: r.context for r in e.context(q).collect()}
    assert c[3] == "" and "eceipt" in c[1]
    assert {r.node_id for r in e.traverse("Approve_Refund", 1).collect()} >= {"F_Approve_Refund", "D_Receipt", "F_Check_Card"}
    before = e.stats()
    e.snapshot(str(tmp_path / "s"))
    e.clear()
    assert e.stats()["atfs"] == 0
    e.restore(str(tmp_path / "s"))
    assert e.stats() == before
    with pytest.raises(ValueError):
        Engine(spark, "x", "bad name!")
    with pytest.raises(ValueError):
        e.call("drop_everything")

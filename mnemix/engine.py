"""One door to a memory kept as Parquet tables: Engine(spark, path, namespace).call(method, **arguments)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemix.operators import density, experience, retrieval, store, topology
from mnemix.operators import memory as M
from mnemix.sources import ingest
from mnemix.sources.tables import checkpointed

RECORD = "id string, doc_seq long, passage_seq int, action string, text string, data array<string>, access array<string>, events array<string>"
LINK = "owner string, target string"
CASE = "question string, seq long, vec array<double>, label int"


class Engine:
    """Base tables are versions in the namespace's folder: a batch writes the next version, then the marker that names it.

    Derived tables (links, nodes, postings) are rebuilt on demand and checkpointed for the queries that share them.
    """

    METHODS = ("ingest", "ingest_batch", "query", "traverse", "context", "search_blocks", "topology_json", "density", "ensure_density", "stats", "store_stats", "snapshot", "restore", "clear", "learn", "forget", "loo_accuracy", "trust", "experience_size")

    def __init__(self, spark: SparkSession, path: str, namespace: str = "main"):
        if not re.fullmatch(r"[A-Za-z0-9_]{1,48}", namespace):
            raise ValueError("a namespace has 1 to 48 letters, digits and underscores")
        self.spark, self.path = spark, f"{path.rstrip('/')}/ns={namespace}"
        self._memory: M.Materialised | None = None
        self._blocks: DataFrame | None = None

    def call(self, method: str, **arguments):
        if method not in self.METHODS:
            raise ValueError(f"unknown method {method!r}")
        return getattr(self, method)(**arguments)

    # tables ---------------------------------------------------------------------------------------------------------

    def _marker(self) -> str:
        return f"{self.path}/current"

    def _version(self) -> str | None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self._marker())
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.text(self._marker()).first()[0]

    def table(self, name: str) -> DataFrame:
        schema = {"records": RECORD, "links": LINK, "experience": CASE, "concepts": "id string, stem string"}[name]
        v = self._version()
        return self.spark.createDataFrame([], schema) if v is None else self.spark.read.schema(schema).parquet(f"{self.path}/{v}/{name}")

    def _commit(self, **changed: DataFrame) -> None:
        v = uuid.uuid4().hex
        for name in ("records", "links", "experience", "concepts"):
            changed.get(name, self.table(name)).write.parquet(f"{self.path}/{v}/{name}")
        self.spark.createDataFrame([(v,)], "v string").coalesce(1).write.mode("overwrite").text(self._marker())
        self._memory = self._blocks = None

    def memory(self) -> M.Materialised:
        if self._memory is None:
            self._memory = M.materialised(self.table("records"), self.table("links"), self.table("concepts"))
        return self._memory

    # methods --------------------------------------------------------------------------------------------------------

    def ingest(self, text: str, format: str = "auto", source: str = "doc") -> dict:
        return self.ingest_batch(self.spark.createDataFrame([(0, text, format, source)], "doc_seq long, text string, format string, source string"))

    def ingest_batch(self, docs: DataFrame) -> dict:
        """docs (doc_seq, text, format, source): parsed, merged newest-wins with what is there.

        format is auto, atf, text or entity_tags.
        """
        records, links = ingest.parsed(checkpointed(docs))
        new = checkpointed(ingest.newest_wins(records))
        self._commit(
            records=ingest.upsert(self.table("records"), new.select(*self.table("records").columns)),
            links=ingest.upsert_links(self.table("links"), links, new),
            concepts=self.table("concepts").join(new.select("id"), "id", "left_anti"),
        )
        return self.stats() | {"ingested": new.count()}

    def query(self, q: str | DataFrame, k: int = 5) -> DataFrame:
        return retrieval.cascade(self.memory(), self._queries(q), k, checkpointed)

    def _queries(self, q: str | DataFrame) -> DataFrame:
        return self.spark.createDataFrame([(0, q)], "query_id long, q string") if isinstance(q, str) else q

    def context(self, q: str | DataFrame, k: int = 5, max_chars: int = 2000) -> DataFrame:
        """Context text of each query; empty where the result is to be handed off."""
        hits = checkpointed(self.query(q, k))
        lines = hits.filter("not handoff").join(self.memory().nodes.select(F.col("node_id").alias("id"), "label", "text"), "id")
        return self._queries(q).select("query_id").join(retrieval.context(lines, max_chars), "query_id", "left").fillna("", ["context"])

    def traverse(self, start: str, hops: int = 2, limit: int = 50) -> DataFrame:
        m = self.memory()
        found = topology.resolved(m.nodes, self.spark.createDataFrame([(start,)], "q string")).select("node_id")
        if found.isEmpty():
            found = self.query(start, 1).select(F.col("id").alias("node_id"))
        return topology.traverse(m.nodes, m.links, found, hops, limit)

    def _edges(self) -> DataFrame:
        return M.edge_list(self.table("records"), self.table("links"), self.table("concepts"))

    def blocks(self) -> DataFrame:
        """(node_id, block) of every node."""
        if self._blocks is None:
            self._blocks = checkpointed(topology.blocks(self.memory().nodes, topology.communities(self._edges())))
        return self._blocks

    def search_blocks(self, q: str | DataFrame) -> DataFrame:
        return topology.search_blocks(self.blocks(), self._queries(q))

    def topology_json(self) -> DataFrame:
        """(block, json): each block with its nodes as a JSON text."""
        return topology.blocks_json(self.memory().nodes, self.blocks(), self.table("records"))

    def density(self) -> dict:
        """The full report, its probes run and the policy checked."""
        m = self.memory()
        return density.full_report(m, self.blocks(), checkpointed(density.probed(m, checkpoint=checkpointed)))

    def ensure_density(self, rounds: int = 3) -> dict:
        _, concepts = density.ensure(self.table("records"), self.table("links"), rounds, checkpointed)
        self._commit(concepts=concepts)
        return self.density()

    def stats(self) -> dict:
        m = self.memory()
        return {
            "atfs": self.table("records").count(), "nodes": m.nodes.count(), "edges": m.links.count(), "experience": self.table("experience").count(),
            "blocks": self.blocks().select("block").distinct().count(), "vocabulary": M.vocabulary(m.postings).count(),
        }

    def store_stats(self) -> dict:
        return store.stats(self.memory(), self.table("records"), self.table("experience")).first().asDict()

    def snapshot(self, path: str) -> None:
        ingest.save_snapshot({n: self.table(n) for n in ("records", "links", "experience", "concepts")}, path)

    def restore(self, path: str) -> None:
        self._commit(**ingest.load_snapshot(self.spark, path, ["records", "links", "experience", "concepts"]))

    def clear(self) -> None:
        self._commit(**{n: self.table(n).limit(0) for n in ("records", "links", "experience", "concepts")})

    def learn(self, cases: DataFrame) -> dict:
        """cases (question, seq, vec, label) are appended; gives each question's leave-one-out accuracy, and its trust by trust().

        The vectors of a question have one length, which its first cases set.
        """
        sizes = cases.select("question", F.size("vec").alias("n")).unionByName(self.table("experience").select("question", F.size("vec").alias("n")))
        if sizes.groupBy("question").agg(F.min("n").alias("a"), F.max("n").alias("b")).filter("a <> b").count():
            raise ValueError("vectors of one question must have one length")
        self._commit(experience=self.table("experience").unionByName(cases.select("question", "seq", F.transform("vec", lambda x: x.cast("double")).alias("vec"), F.col("label").cast("int").alias("label"))))
        return self.loo_accuracy()

    def loo_accuracy(self, k: int = 8) -> dict:
        e = checkpointed(self.table("experience"))
        out = {}
        for r in e.select("question").distinct().collect():
            c = e.filter(F.col("question") == r.question)
            out[r.question] = experience.loo_vote_accuracy(experience.neighbours(c, experience.loo_probes(c), k), k).first().accuracy
        return out

    def trust(self) -> dict:
        """How far each question's memory beats its commonest label, from 0 to 1."""
        e = checkpointed(self.table("experience"))
        out = {}
        for r in e.select("question").distinct().collect():
            c = e.filter(F.col("question") == r.question)
            out[r.question] = experience.trust(c, experience.neighbours(c, experience.loo_probes(c), 8)).first().trust
        return out

    def experience_size(self) -> int:
        return self.table("experience").count()

    def forget(self) -> None:
        self._commit(experience=self.table("experience").limit(0))

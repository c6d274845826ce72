"""Memory tables: nodes, links, degrees, postings, vocabulary and grams, each a plain aggregation over records."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemix.functions import text as T
from mnemix.sources.tables import running, saved

LABEL_WEIGHT, TEXT_WEIGHT = 3.0, 1.0
LEVEL_RANK = {"function": 0, "data": 1, "concept": 2, "event": 3, "access": 4}
PREFIX = {"function": "F_", "data": "D_", "access": "A_", "event": "E_", "concept": "K_"}


@dataclass
class Memory:
    nodes: DataFrame  # node_id, level, level_rank, label, text, degree, fdeg
    links: DataFrame  # a, b with a < b
    postings: DataFrame  # term, node_id, tf
    lengths: DataFrame  # node_id, len


def typed_links(records: DataFrame, context: DataFrame | None = None, concepts: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """(a, b, owner), a < b, without loops or repeats: uses of data, grants of access, events, context links with both ends, concepts.

    Where ids are unique, a record's own links to what it uses repeat within its lists only, and need no shuffle.
    """
    ordered = lambda d: d.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "owner").filter("a <> b")
    once = lambda d: ordered(d).groupBy("a", "b").agg(F.min("owner").alias("owner"))
    if unique:
        e = records.select("id", *[F.array_distinct(c).alias(c) for c in ("data", "access", "events") if c in records.columns])
        parts = [ordered(e.select(F.concat(F.lit("F_"), F.col("id")).alias("x"), F.explode(c).alias("y"), F.col("id").alias("owner")).withColumn("y", F.concat(F.lit(PREFIX[n]), "y"))) for c, n in (("data", "data"), ("access", "access"), ("events", "event")) if c in e.columns]
        if context is not None or concepts is not None:
            parts.append(once(_given_links(records, context, concepts)))
        all_ = parts[0]
        for p in parts[1:]:
            all_ = all_.unionByName(p)
        return all_
    parts = []
    for column, level in (("data", "data"), ("access", "access"), ("events", "event")):
        if column in records.columns:
            e = records.select(F.concat(F.lit("F_"), F.col("id")).alias("x"), F.explode(column).alias("y"), F.col("id").alias("owner"))
            parts.append(e.select("x", F.concat(F.lit(PREFIX[level]), "y").alias("y"), "owner"))
    if context is not None or concepts is not None:
        parts.append(_given_links(records, context, concepts))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return once(all_)


def _given_links(records: DataFrame, context: DataFrame | None, concepts: DataFrame | None) -> DataFrame:
    """(x, y, owner) of context links with both ends, and of concepts."""
    parts = []
    if context is not None:
        ids = records.select("id").distinct()
        c = context.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(ids.withColumnRenamed("id", "owner"), "owner", "left_semi")
        parts.append(c.select(F.concat(F.lit("F_"), "owner").alias("x"), F.concat(F.lit("F_"), "target").alias("y"), "owner"))
    if concepts is not None:
        parts.append(concepts.select(F.concat(F.lit("F_"), "id").alias("x"), F.concat(F.lit("K_"), "stem").alias("y"), F.col("id").alias("owner")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def edge_list(records: DataFrame, context: DataFrame | None = None, concepts: DataFrame | None = None) -> DataFrame:
    """(a, b, seq): the edges in the order they are made, repeated ones kept: each record's data, access and events, then context links, then concepts."""
    order = ["doc_seq", "passage_seq"]
    parts = []
    for level, column in enumerate(("data", "access", "events")):
        if column in records.columns:
            kind = {"data": "data", "access": "access", "events": "event"}[column]
            e = records.select(F.lit(0).alias("part"), *order, F.concat(F.lit("F_"), "id").alias("a"), F.lit(level).alias("level"), F.posexplode(column).alias("at", "y"))
            parts.append(e.select("part", *order, "a", "level", "at", F.concat(F.lit(PREFIX[kind]), "y").alias("b")))
    place = lambda part, a, b: [F.lit(part).alias("part"), F.lit(0).cast("long").alias("doc_seq"), F.lit(0).alias("passage_seq"), a.alias("a"), F.lit(0).alias("level"), F.lit(0).alias("at"), b.alias("b")]
    if context is not None:
        ids = records.select("id").distinct()
        c = context.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(ids.withColumnRenamed("id", "owner"), "owner", "left_semi").filter("owner <> target")
        parts.append(c.select(*place(1, F.concat(F.lit("F_"), "owner"), F.concat(F.lit("F_"), "target"))))
    if concepts is not None:
        parts.append(concepts.select(*place(2, F.concat(F.lit("F_"), "id"), F.concat(F.lit("K_"), "stem"))))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return running(all_, ["part", *order, "a", "level", "at", "b"], F.lit(1).cast("long"), "seq").select("a", "b", "seq")


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(links: DataFrame) -> DataFrame:
    """(node_id, degree, fdeg): distinct neighbours, and those of them that are records."""
    return both_ways(links).groupBy(F.col("a").alias("node_id")).agg(F.count("*").alias("degree"), F.count_if(F.col("b").startswith("F_")).alias("fdeg"))


def node_table(records: DataFrame, links: DataFrame, unique: bool = False) -> DataFrame:
    """Every record is a node; another node lives while a link holds it.

    Where ids are unique and a record is linked only with what its own lists hold, these give its degree, and only the
    other nodes' links are counted, before a shuffle.
    """
    label = F.when((F.col("action") == "") | (F.col("action") == F.col("id")), F.col("id")).otherwise(F.concat_ws(" ", "id", "action"))
    shared = lambda d: d.select("node_id", F.substr("node_id", F.lit(3)).alias("label"), F.lit("").alias("text"))
    if unique:
        held = sum((F.size(F.array_distinct(F.coalesce(c, F.array()))) for c in ("data", "access", "events") if c in records.columns), F.lit(0))
        own = records.select(F.concat(F.lit("F_"), "id").alias("node_id"), label.alias("label"), "text", held.cast("long").alias("degree"), F.lit(0).cast("long").alias("fdeg"))
        other = F.when(F.col("a").startswith("F_"), F.col("b")).otherwise(F.col("a"))
        counted = links.groupBy(other.alias("node_id")).agg(F.count("*").alias("degree"))
        d = own.unionByName(counted.select("node_id", F.substr("node_id", F.lit(3)).alias("label"), F.lit("").alias("text"), "degree", F.col("degree").alias("fdeg")))
    else:
        own = records.select(F.concat(F.lit("F_"), "id").alias("node_id"), label.alias("label"), "text")
        others = both_ways(links).select(F.col("a").alias("node_id")).distinct().filter(~F.col("node_id").startswith("F_"))
        d = own.unionByName(shared(others)).join(degrees(links), "node_id", "left").fillna(0, ["degree", "fdeg"])
    level = F.coalesce(*[F.when(F.col("node_id").startswith(p), F.lit(n)) for n, p in PREFIX.items()], F.lit("concept"))
    rank = F.coalesce(*[F.when(F.col("level") == n, F.lit(r)) for n, r in LEVEL_RANK.items()])
    return d.withColumn("level", level).withColumn("level_rank", rank)


def weighted_postings(nodes: DataFrame) -> DataFrame:
    """(term, node_id, tf, len): three times the uses in the label plus the uses in the text; len is their sum over the node's terms.

    Nodes are dealt with their lists of terms, so terms are counted where they are.
    """
    rows = nodes.select("node_id", T.terms_of(F.col("label")).alias("l"), T.terms_of(F.col("text")).alias("t")).repartition("node_id")
    rows = rows.withColumn("len", LABEL_WEIGHT * F.size("l") + TEXT_WEIGHT * F.size("t"))
    weighed = F.concat(F.transform("l", lambda t: F.struct(t.alias("term"), F.lit(LABEL_WEIGHT).alias("w"))), F.transform("t", lambda t: F.struct(t.alias("term"), F.lit(TEXT_WEIGHT).alias("w"))))
    return rows.select("node_id", "len", F.explode(weighed).alias("x")).groupBy("node_id", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("tf"), F.first("len").alias("len")).select("term", "node_id", "tf", "len")


def stem_postings(postings: DataFrame) -> DataFrame:
    return postings.groupBy(T.stem(F.col("term")).alias("term"), "node_id").agg(F.sum("tf").alias("tf"))


def lengths(nodes: DataFrame, postings: DataFrame) -> DataFrame:
    return nodes.select("node_id").join(postings.groupBy("node_id").agg(F.sum("tf").alias("len")), "node_id", "left").fillna(0.0, ["len"])


def vocabulary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df")).withColumn("ngrams", F.size(T.trigrams(F.col("term"))))


def vocabulary_of(memory) -> DataFrame:
    """The vocabulary of a memory, from the table it keeps where it keeps one."""
    return memory.vocab if isinstance(memory, Materialised) else vocabulary(memory.postings)


def vocabulary_grams(vocab: DataFrame) -> DataFrame:
    return vocab.select(F.explode(T.trigrams(F.col("term"))).alias("gram"), "term", "ngrams")


def build(records: DataFrame, context: DataFrame | None = None, concepts: DataFrame | None = None) -> Memory:
    """records: id, action, text and any of data, access, events (arrays)."""
    links = typed_links(records, context, concepts)
    nodes = node_table(records, links)
    postings = weighted_postings(nodes)
    return Memory(nodes, links, postings, lengths(nodes, postings))


class Materialised:
    """The tables of build(), each written when it is first asked for and made from the ones before it."""

    def __init__(self, records: DataFrame, context: DataFrame | None = None, concepts: DataFrame | None = None, unique: bool = False):
        self._given = records, context, concepts
        self._unique = unique

    @cached_property
    def records(self) -> DataFrame:
        return saved(self._given[0], "records")

    @cached_property
    def links(self) -> DataFrame:
        return saved(typed_links(self.records, *self._given[1:], unique=self._unique), "links")

    @cached_property
    def nodes(self) -> DataFrame:
        return saved(node_table(self.records, self.links, self._unique and self._given[1:] == (None, None)), "nodes")

    @cached_property
    def postings(self) -> DataFrame:
        return saved(weighted_postings(self.nodes), "postings")

    @cached_property
    def lengths(self) -> DataFrame:
        return saved(lengths(self.nodes, self.postings), "lengths")

    @cached_property
    def vocab(self) -> DataFrame:
        return saved(vocabulary(self.postings), "vocabulary")


def materialised(records: DataFrame, context: DataFrame | None = None, concepts: DataFrame | None = None) -> Materialised:
    return Materialised(records, context, concepts)


def passage_memory(passages: DataFrame) -> Materialised:
    """The memory of passages, one row an id."""
    return Materialised(passages.withColumn("action", F.lit("Passage")), unique=True)


def neighbourhood(links: DataFrame, seeds: DataFrame, most_degree: int = 25, limit: int = 200) -> DataFrame:
    """(seed, id): records that share a node of at most most_degree records with a seed, or link to it; at most limit a seed.

    The degree filter comes before the second join, so no hub is expanded.
    """
    from pyspark.sql import Window

    d = both_ways(links)
    narrow = d.filter("b like 'F@_%' escape '@' and not a like 'F@_%' escape '@'").groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") <= most_degree)
    s = seeds.select(F.concat(F.lit("F_"), "id").alias("seed")).distinct()
    near = s.join(d, s.seed == d.a).select("seed", F.col("b").alias("mid"))
    over = near.join(narrow.select(F.col("a").alias("mid")), "mid").join(d.select(F.col("a").alias("mid"), F.col("b").alias("other")), "mid")
    direct = near.filter(F.col("mid").startswith("F_")).select("seed", F.col("mid").alias("other"))
    found = over.select("seed", "other").unionByName(direct).distinct().join(s.withColumnRenamed("seed", "other"), "other", "left_anti")
    w = Window.partitionBy("seed").orderBy("other")
    return found.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).select(F.substr("seed", F.lit(3)).alias("seed"), F.substr("other", F.lit(3)).alias("id"))

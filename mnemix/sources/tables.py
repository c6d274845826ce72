"""Access to tables: reading them, the shared folder, intermediate tables, and spreading rows over the cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where a local session names none, as in tests, a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="mnemix-"))
    return sc.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder; unlike a checkpoint, later reads prune columns. It goes when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mnemix-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a scan of few splits would leave the work behind it to few tasks."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def few(df: DataFrame, most: int = 300_000) -> DataFrame:
    """df, marked for broadcast where it has at most `most` rows; a larger one meets its partner by a shuffle. df should be cheap to read."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", most: int = 50_000) -> DataFrame:
    """left joined with right, which is unique by keys, where one key may hold any share of left's rows.

    Keys that hold more than one in `most` of left's rows, and more than a thousand, are `most` at the most: they are
    broadcast, so their rows stay where they are; the others meet by a shuffle.
    """
    n = left.groupBy(*keys).agg(F.count("*").alias("__n"))
    least = max(1000, (left.count() or 1) // most)
    hot = right.join(n.filter(F.col("__n") > least).drop("__n"), keys, "left_semi")
    some = saved(hot, "hot")
    if some.isEmpty():
        return left.join(right, keys, how)
    return left.join(F.broadcast(some), keys).unionByName(left.join(F.broadcast(some.select(*keys)), keys, "left_anti").join(right, keys, how))


def running(df: DataFrame, order: list, value, name: str) -> DataFrame:
    """df with name: the sum of value over the rows up to and with each, in the given order of all rows.

    Ranges of the order are summed apart; what lies before a range is one number a partition.
    """
    up = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = saved(df.withColumn("__value", value).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    before, at = [], 0
    for r in ranged.groupBy("__part").agg(F.sum("__value").alias("n")).orderBy("__part").collect():  # one row a partition
        before.append((r["__part"], at))
        at += r.n
    kind = dict(ranged.agg(F.sum("__value").alias("n")).dtypes)["n"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, f"__part int, __before {kind}"))
    return ranged.join(offsets, "__part").withColumn(name, F.sum("__value").over(up) + F.col("__before")).drop("__part", "__value", "__before")


def components(edges: DataFrame, most_rounds: int = 200, salts: int = 16) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b): root is the smallest node it is connected with.

    Each round every node takes the smallest label among its own and its neighbours', then the label of that label, so
    that chains halve. Only minima are aggregated, so a node with very many neighbours is reduced before the shuffle;
    labels that have moved are few and are offered once for each of several salts, so that the members of a large
    component do not meet in one task. Rounds are written; the loop ends when no label changes.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    salt = F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")
    for _ in range(most_rounds):
        offered = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("offer"))
        near = labels.join(offered, F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("offer", "root")).alias("root"))
        near = saved(near, "near")
        tops = near.select(F.col("root").alias("u")).distinct()
        moved = near.filter("root <> node").select(F.col("node").alias("u"), F.col("root").alias("top")).join(tops, "u", "left_semi")
        moved = moved.select("u", "top", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
        up = near.withColumn("s", salt).join(moved.withColumnRenamed("s", "s2"), (F.col("root") == F.col("u")) & (F.col("s") == F.col("s2")), "left")
        new = saved(up.select("node", "old", F.least("root", F.coalesce("top", "root")).alias("root")), "labels")
        labels = new.select("node", "root")
        if new.filter("root <> old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")

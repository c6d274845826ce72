"""What the operators share: table access, the shared folder, stable hashes and connected components."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from mnemix.sources.tables import checkpointed, components, looked_up, read, saved, shared_dir, spread

__all__ = ["checkpointed", "components", "fold", "looked_up", "pii_key", "read", "sample_hash", "saved", "shared_dir", "spread"]


def pii_key(spark: SparkSession) -> str:
    """The pseudonyms' secret key: spark.mnemix.pii.key of the session; a session without one, as in tests, gets a public one."""
    return spark.conf.get("spark.mnemix.pii.key", "a public key, for tests only")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def sample_hash(*cols: Column) -> Column:
    """A uniform number in [0, 1) that depends on the values alone."""
    return (F.xxhash64(F.lit(20011), *cols).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))

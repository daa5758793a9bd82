"""Views over any log-shaped DataFrame. All are lazy and compose with the rest of Spark SQL.

Key predicates may be put on a view's result: Catalyst moves them below the per-key aggregate into the scan.
Predicates on ``op`` or ``value`` must stay above it, as an older version must not stand in for a newer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.log import PUT


def merged(log: DataFrame) -> DataFrame:
    """Newest row of each key, tombstones included. Partial aggregation keeps one row per key and map task."""
    newest = F.max(F.struct("seq", "op", "value")).alias("n")
    return log.groupBy("key").agg(newest).select("key", "n.op", "n.value", "n.seq")


def live(log: DataFrame) -> DataFrame:
    """Newest value of each key whose newest row is a put."""
    return merged(log).where(F.col("op") == PUT).select("key", "value", "seq")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The log as it stood after mutation ``seq``."""
    return log.where(F.col("seq") <= seq)


def _between(lo, hi) -> Column:
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col("key") >= F.lit(lo))
    if hi is not None:
        cond = cond & (F.col("key") <= F.lit(hi))
    return cond


def get(log: DataFrame, key) -> DataFrame:
    """Zero or one row (key, value)."""
    return live(log.where(F.col("key") == F.lit(key))).select("key", "value")


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, found, value) for every probe row; deleted and never-written keys are not found.

    The log is first cut to probed keys by a semi join, so the aggregate sees only their versions. The probe side is
    broadcast when Spark's own size check allows it.
    """
    wanted = keys.select("key").distinct()
    hits = live(log.join(wanted, "key", "left_semi")).select("key", "value", F.lit(True).alias("hit"))
    return keys.select("key").join(hits, "key", "left").select(
        "key", F.coalesce("hit", F.lit(False)).alias("found"), "value")


def scan(log: DataFrame, lo=None, hi=None) -> DataFrame:
    """Live rows with ``lo <= key <= hi`` in key order. Both ends are inclusive; None means open; "" is the empty key."""
    return live(log.where(_between(lo, hi))).select("key", "value").orderBy("key")


def seek(log: DataFrame, key, hi=None) -> DataFrame:
    """The first live row at or after ``key``."""
    return scan(log, key, hi).limit(1)


def scan_limit(log: DataFrame, key, n: int, hi=None) -> DataFrame:
    """The first ``n`` live rows from ``key``: planned as a top-n, not a global sort."""
    return scan(log, key, hi).limit(n)


def cursor(log: DataFrame, lo=None, hi=None):
    """Python iterator over a scan, one partition at a time."""
    return ((r["key"], r["value"]) for r in scan(log, lo, hi).toLocalIterator())

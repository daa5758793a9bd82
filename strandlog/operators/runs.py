"""Operators on runs: log-shaped rows with a ``run`` number, larger meaning newer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions.checksums import bloom_positions
from strandlog.log import DEL, PUT
from strandlog.operators.views import live, merged

BITS_PER_KEY, HASHES = 10, 7


def flush(log: DataFrame) -> DataFrame:
    """Newest row of each key inside each run; tombstones stay, as older runs may still hold the key."""
    newest = F.max(F.struct("seq", "op", "value")).alias("n")
    return log.groupBy("run", "key").agg(newest).select("run", "key", "n.op", "n.value", "n.seq")


def merge_runs(runs: DataFrame) -> DataFrame:
    """Newest row of each key by run order alone: one shuffle instead of a chain of outer joins."""
    newest = F.max(F.struct("run", "op", "value")).alias("n")
    return runs.groupBy("key").agg(newest).select("key", "n.op", "n.value")


def compact(runs: DataFrame) -> DataFrame:
    """Full merge: one version of each key, tombstones dropped. Only valid over all runs up to the oldest."""
    return live(runs)


def compact_prefix(runs: DataFrame, before: int) -> DataFrame:
    """Runs older than ``before`` compacted into one that sorts first; later runs stay as they are."""
    old = live(runs.where(F.col("run") < before)).select(
        F.lit(-1).cast("long").alias("run"), "key", F.lit(PUT).alias("op"), "value", "seq")
    return old.unionByName(runs.where(F.col("run") >= before).select("run", "key", "op", "value", "seq"))


def _record_bytes():
    return F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))


def run_meta(runs: DataFrame) -> DataFrame:
    """Per run: rows, tombstones, key bounds, newest seq and net bytes, over its flushed rows."""
    return flush(runs).groupBy("run").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("op") == DEL, 1).otherwise(0)).cast("long").alias("tombstones"),
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.max("seq").alias("max_seq"),
        F.sum(_record_bytes()).cast("long").alias("net_bytes"))


def memtable_size(runs: DataFrame) -> DataFrame:
    return run_meta(runs).select("run", "net_bytes")


def sst_index(runs: DataFrame) -> DataFrame:
    """Offset and size of each record of a run written in key order (7 bytes of header and the key and value)."""
    size = (F.lit(7) + _record_bytes()).cast("long")
    before = Window.partitionBy("run").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    sized = flush(runs).select("run", "key", size.alias("rec_size"))
    return sized.select("run", "key", F.coalesce(F.sum("rec_size").over(before), F.lit(0)).alias("rec_offset"), "rec_size")


def bloom_bits(runs: DataFrame) -> DataFrame:
    """Set bit positions of each run's filter, 10 bits and 7 hashes a key."""
    keys = flush(runs).select("run", "key")
    sizes = keys.groupBy("run").agg((F.count("*") * BITS_PER_KEY).alias("bits"))
    return (keys.join(sizes, "run").select("run", "bits", F.explode(bloom_positions(F.col("key"), F.col("bits"), HASHES)).alias("bit"))
            .distinct())


def candidate_runs(runs: DataFrame, keys: DataFrame) -> DataFrame:
    """Runs that hold a probed key: those whose filter has all its bits, rechecked against the run's keys.

    A filter's size is its run's number of keys, so a probe's bits are known from the runs' sizes alone; a run's keys set
    only the bits that are probed, before anything is shuffled.
    """
    held = runs.select("run", "key").distinct()
    sizes = held.groupBy("run").agg((F.count("*") * BITS_PER_KEY).alias("bits"))
    probes = keys.select("key").distinct().join(sizes, how="cross")
    need = probes.select("run", "key", F.explode(F.array_distinct(bloom_positions(F.col("key"), F.col("bits"), HASHES))).alias("bit"))
    bits = (held.withColumnRenamed("key", "own").join(sizes, "run")
            .select("run", F.explode(bloom_positions(F.col("own"), F.col("bits"), HASHES)).alias("bit")))
    hit = bits.join(need.select("run", "bit").distinct(), ["run", "bit"], "left_semi").distinct().withColumn("hit", F.lit(True))
    maybe = (need.join(hit, ["run", "bit"], "left").groupBy("run", "key")
             .agg(F.min(F.col("hit").isNotNull()).alias("all_set")).where("all_set").select("run", "key"))
    return maybe.join(held, ["run", "key"], "left_semi")


def orphan_logs(log_ids: DataFrame, run_ids: DataFrame) -> DataFrame:
    """Logs without a run of the same number: those that recovery must replay."""
    return log_ids.join(run_ids, "run", "left_anti")


def recover(log: DataFrame, bad) -> DataFrame:
    """The prefix of the log before its first corrupt record."""
    first = log.where(bad).agg(F.min("seq").alias("first_bad"))
    return log.join(F.broadcast(first), on=F.col("first_bad").isNull() | (F.col("seq") < F.col("first_bad"))).drop("first_bad")


def recovered_live(log: DataFrame, bad) -> DataFrame:
    return live(recover(log, bad))


__all__ = ["bloom_bits", "candidate_runs", "compact", "compact_prefix", "flush", "memtable_size", "merge_runs", "merged",
           "orphan_logs", "recover", "recovered_live", "run_meta", "sst_index"]


def log_gaps(log: DataFrame, cell: int = 1 << 20) -> DataFrame:
    """(last, next, missing) of every gap in the sequence numbers: the numbers beside it and how many are missing between.

    ``lag`` runs inside cells of ``cell`` numbers; between cells only their least and largest numbers are compared, one row
    a cell. Repeated numbers are no gap, NULL numbers are ignored, and an empty log or one number has none.
    """
    seqs = log.where("seq IS NOT NULL").select("seq", F.floor(F.col("seq") / F.lit(cell)).alias("cell"))
    inside = seqs.select(F.lag("seq").over(Window.partitionBy("cell").orderBy("seq")).alias("last"), F.col("seq").alias("next"))
    ends = seqs.groupBy("cell").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    between = ends.select(F.lag("hi").over(Window.orderBy("cell")).alias("last"), F.col("lo").alias("next"))
    return inside.union(between).where("next > last + 1").withColumn("missing", F.col("next") - F.col("last") - 1)

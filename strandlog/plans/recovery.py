"""Recovery of a folder of binary logs and runs: what each file is worth, and the rows that survive.

* A sound run is taken as it is, and a log of its number is redundant.
* A corrupt run is rebuilt from the log of its number: the newest row of each key. Without that log it is lost.
* A log without a run is replayed, up to its first bad record.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.checksums import run_number
from strandlog.log import DEL, PUT
from strandlog.sources.codec import decode_log, decode_run, log_state

SLICE = 10_000


@dataclass(frozen=True)
class Recovered:
    """rows: (run, max_seq, key, op, value), the newest row of each key and run. files: (path, run, kind, state, fate)."""

    rows: DataFrame
    files: DataFrame

    def live(self) -> DataFrame:
        """(key, value) of the newest run of each key, by the runs' newest sequence numbers."""
        newest = F.max(F.struct("max_seq", "run", "op", "value")).alias("n")
        return self.rows.groupBy("key").agg(newest).where(F.col("n.op") == PUT).select("key", "n.value")

    def last_seq(self) -> int:
        return int(self.rows.agg(F.max("max_seq")).first()[0] or 0)


def _decoded(frames):
    """One row a record, and one without a key for the file itself."""
    columns = ["path", "kind", "state", "seq", "op", "key", "value"]
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            data, kind = bytes(content), path[-3:]
            try:
                if kind == "sst":
                    seq, found = decode_run(data)
                    rows, state = [(seq, int(v is None), k, v) for k, v in found], "whole"
                else:
                    rows, state = list(decode_log(data)), log_state(data)
            except Exception:  # any damage: offsets and lengths lead anywhere
                rows, state = [], "corrupt"
            for i in range(0, len(rows), SLICE):
                yield pd.DataFrame([(path, kind, state, *r) for r in rows[i : i + SLICE]], columns=columns)
            yield pd.DataFrame([(path, kind, state, None, None, None, None)], columns=columns)


def recover_folder(spark: SparkSession, path: str) -> Recovered:
    """What ``path`` holds. Files that are neither ``.wal`` nor ``.sst`` are ignored; an empty folder gives empty tables."""
    read = (spark.read.format("binaryFile").option("pathGlobFilter", "*.{wal,sst}").load(path).select("path", "content")
            .mapInPandas(_decoded, "path string, kind string, state string, seq long, op int, key binary, value binary"))
    read = read.withColumn("run", run_number(F.col("path")))
    files = read.where("key IS NULL AND op IS NULL").select("path", "run", "kind", "state")
    has = files.groupBy("run").agg(
        F.max(F.expr("kind = 'sst' AND state = 'whole'")).alias("sound"), F.max(F.expr("kind = 'sst'")).alias("run_file"),
        F.max(F.expr("kind = 'wal'")).alias("log_file"))
    fate = (F.when(F.expr("kind = 'sst' AND state = 'whole'"), "kept")
            .when(F.expr("kind = 'sst'"), F.when(F.col("log_file"), "rebuilt").otherwise("lost"))
            .when(F.col("sound"), "redundant").otherwise("replayed"))
    judged = files.join(has, "run").select("path", "run", "kind", "state", fate.alias("fate"))
    rows = read.where("op IS NOT NULL").join(has.select("run", "sound"), "run").where(
        (F.col("kind") == "sst") & F.col("sound") | (F.col("kind") == "wal") & ~F.col("sound"))
    newest = F.max(F.struct("seq", "op", "value")).alias("n")
    flushed = rows.groupBy("run", "key").agg(newest).select("run", "key", "n.op", "n.value", F.col("n.seq").alias("seq"))
    top = flushed.groupBy("run").agg(F.max("seq").alias("max_seq"))
    return Recovered(flushed.join(top, "run").select("run", "max_seq", "key", "op", F.when(F.col("op") != DEL, F.col("value")).alias("value")), judged)

"""A persistent table: immutable, key-sorted Parquet runs and a manifest that names them.

Every change publishes manifest N + 1 by exclusive creation; a reader keeps the version it opened, so a snapshot never
moves. Runs hold the newest row of each key, tombstones included, and have Bloom filters on the key. A manifest has one
line of bounds per run, never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.log import PUT, deletes, numbered, puts, validated
from strandlog.operators import views as V
from strandlog.sources.files import Files

SCHEMA = "seq bigint, op int, key string, value string"


class Conflict(RuntimeError):
    """Another writer published the same version first; nothing was changed."""


@dataclass(frozen=True)
class Options:
    """compact_at: number of runs from which ``maybe_compact`` merges. partitions: files of a run (None: as Spark's
    shuffle partitions). retries: times that a write or compaction is done again on the newest version after another
    writer was first. notify: called with "flush" or "compact" and the run, after each is published."""

    compact_at: int = 8
    partitions: int | None = None
    retries: int = 0
    notify: Callable[[str, dict], None] | None = None


class Table:
    """Opens the newest version, or the given one, of the table at ``path``; a missing table is empty."""

    def __init__(self, spark: SparkSession, path: str, options: Options = Options(), version: int | None = None):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self.files = Files(spark, path)
        self.refresh(version)

    # -- versions

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("manifest") if n.endswith(".json")]

    def refresh(self, version: int | None = None) -> Table:
        found = self.versions()
        if version is not None and version not in found and version != 0:
            raise ValueError(f"no version {version}")
        self.version = version if version is not None else max(found, default=0)
        self.manifest = json.loads(self.files.read(f"manifest/{self.version:09d}.json")) if self.version else {
            "runs": [], "last_seq": 0, "batches": {}}
        return self

    def _publish(self, runs: list[dict], last_seq: int, batches: dict) -> None:
        manifest = {"runs": runs, "last_seq": last_seq, "batches": batches}
        if not self.files.create(f"manifest/{self.version + 1:09d}.json", json.dumps(manifest)):
            raise Conflict(f"version {self.version + 1} of {self.path} exists")
        self.version, self.manifest = self.version + 1, manifest

    def _write_run(self, rows: DataFrame) -> dict:
        name = f"runs/{uuid.uuid4().hex}"
        n = self.options.partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        (rows.select("seq", "op", "key", "value").repartitionByRange(n, "key").sortWithinPartitions("key").write
         .option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/{name}"))
        stats = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}").agg(
            F.count("*").alias("n"), F.coalesce(F.sum("op"), F.lit(0)).alias("tombstones"), F.min("key").alias("min_key"),
            F.max("key").alias("max_key"), F.max("seq").alias("max_seq")).first()
        return {"name": name, **stats.asDict()}

    # -- writes

    def apply(self, mutations: DataFrame, order_by: str, stream: str | None = None, batch_id: int | None = None) -> Table:
        """Appends (op, key, value) rows in the order of ``order_by`` as one run. A stream's batch is applied once only."""
        valid = validated(mutations)
        for attempt in range(self.options.retries + 1):
            if stream is not None and self.manifest["batches"].get(stream, -1) >= batch_id:
                return self
            last = self.manifest["last_seq"]
            run = self._write_run(V.merged(numbered(valid, order_by, last)))
            batches = dict(self.manifest["batches"])
            if stream is not None:
                batches[stream] = batch_id
            runs = self.manifest["runs"] + ([run] if run["n"] else [])
            try:
                self._publish(runs, max(last, run["max_seq"] or 0), batches)
            except Conflict:
                self.files.delete(run["name"])  # numbered after an older version
                if attempt == self.options.retries:
                    raise
                self.refresh()
            else:
                self._tell("flush", run)
                return self

    def _tell(self, what: str, run: dict) -> None:
        if self.options.notify and run["n"]:
            self.options.notify(what, run)

    def put(self, rows: DataFrame, order_by: str = "key") -> Table:
        return self.apply(puts(rows), order_by)

    def delete(self, keys: DataFrame, order_by: str = "key") -> Table:
        return self.apply(deletes(keys), order_by)

    # -- reads

    def log(self, lo=None, hi=None) -> DataFrame:
        """Rows of all runs of this version; runs whose key bounds miss [lo, hi] are not read."""
        names = [f"{self.path}/{r['name']}" for r in self.manifest["runs"]
                 if (lo is None or r["max_key"] >= lo) and (hi is None or r["min_key"] <= hi)]
        return self.spark.read.schema(SCHEMA).parquet(*names) if names else self.spark.createDataFrame([], SCHEMA)

    def get(self, key: str) -> DataFrame:
        return V.get(self.log(key, key), key)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return V.multi_get(self.log(), keys)

    def scan(self, lo=None, hi=None) -> DataFrame:
        return V.scan(self.log(lo, hi), lo, hi)

    def seek(self, key, hi=None) -> DataFrame:
        return V.seek(self.log(key, hi), key, hi)

    def live(self) -> DataFrame:
        return V.live(self.log())

    # -- maintenance

    def compact(self) -> Table:
        """All runs of this version as one, without tombstones and old versions. Runs that others add meanwhile stay behind it."""
        old = self.manifest["runs"]
        if not old:
            return self
        run = self._write_run(self.live().withColumn("op", F.lit(PUT)))
        for attempt in range(self.options.retries + 1):
            try:
                self._publish(([run] if run["n"] else []) + self.manifest["runs"][len(old):], self.manifest["last_seq"], self.manifest["batches"])
            except Conflict:
                self.refresh()
                if attempt == self.options.retries or self.manifest["runs"][: len(old)] != old:  # or compacted by another
                    self.files.delete(run["name"])
                    raise
            else:
                self._tell("compact", run)
                return self

    def maybe_compact(self) -> bool:
        due = len(self.manifest["runs"]) >= self.options.compact_at
        if due:
            self.compact()
        return due

    def vacuum(self, keep: int = 1, grace: float = 3600.0) -> list[str]:
        """Deletes all versions but the last ``keep`` and the runs that they don't name. Open older snapshots end here.

        Runs and staged files that no version ever named (of lost races and crashes) go once they are ``grace`` seconds old.
        """
        found = self.versions()
        old, kept = found[:-keep], found[-keep:]
        used = {r["name"] for v in kept for r in json.loads(self.files.read(f"manifest/{v:09d}.json"))["runs"]}
        named = {r["name"] for v in old for r in json.loads(self.files.read(f"manifest/{v:09d}.json"))["runs"]}
        for v in old:
            self.files.delete(f"manifest/{v:09d}.json")
        gone = named - used
        for folder in ("runs", "_staged"):
            for name in self.files.names(folder):
                name = f"{folder}/{name}"
                if name not in used | named and self.files.age(name) >= grace:
                    gone.add(name)
        for name in sorted(gone):
            self.files.delete(name)
        return sorted(gone)

"""The driver's queries over the canonical log, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlog.functions import checksums as C
from strandlog.log import load_log, with_run
from strandlog.operators import runs as R
from strandlog.operators import views as V

PROBES = ("user000000", "user000003", "user000005", "userXXXXXX")
BLOOM_PROBES = ("user000000", "user000012", "userXXXXXX")


def _keys(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def _runs(s, d):
    return with_run(load_log(s, d))


def _bad():
    return (F.col("seq") >= 400) & F.col("value").endswith('"k": 0}')


def _logs(s, d):
    return _runs(s, d).select("run").distinct()


QUERIES = {
    "kv_log": lambda s, d: load_log(s, d),
    "kv_latest": lambda s, d: V.merged(load_log(s, d)),
    "kv_live": lambda s, d: V.live(load_log(s, d)),
    "kv_get": lambda s, d: V.get(load_log(s, d), "user000007"),
    "kv_multi_get": lambda s, d: V.multi_get(load_log(s, d), _keys(s, PROBES)),
    "kv_scan": lambda s, d: V.scan(load_log(s, d), "user000003", "user000010"),
    "kv_seek": lambda s, d: V.seek(load_log(s, d), "user000003"),
    "kv_scan_limit": lambda s, d: V.scan_limit(load_log(s, d), "user000005", 3),
    "kv_snapshot": lambda s, d: V.live(V.as_of(load_log(s, d), 500)),
    "kv_run_flush": lambda s, d: R.flush(_runs(s, d)),
    "kv_run_merge": lambda s, d: R.merge_runs(R.flush(_runs(s, d))),
    "kv_compact": lambda s, d: R.compact(R.flush(_runs(s, d))),
    "kv_compact_prefix": lambda s, d: V.live(R.compact_prefix(R.flush(_runs(s, d)), 2)),
    "kv_run_meta": lambda s, d: R.run_meta(_runs(s, d)),
    "kv_sst_index": lambda s, d: R.sst_index(_runs(s, d)),
    "kv_candidate_runs": lambda s, d: R.candidate_runs(R.flush(_runs(s, d)), _keys(s, BLOOM_PROBES)),
    "kv_log_gaps": lambda s, d: R.log_gaps(load_log(s, d).where(F.col("op") == 0)),
    "kv_orphan_wal": lambda s, d: R.orphan_logs(_logs(s, d), _logs(s, d).where("run % 2 = 0")),
    "kv_wal_recover": lambda s, d: R.recovered_live(load_log(s, d), _bad()),
    "kv_filenames": lambda s, d: _logs(s, d).withColumns({"wal": C.run_name(F.col("run"), "wal")}).withColumns(
        {"sst": C.log_to_run_name(F.col("wal")), "parsed": C.run_number(F.col("wal"))}),
    "kv_memtable_size": lambda s, d: R.memtable_size(_runs(s, d)),
    "kv_crc32": lambda s, d: load_log(s, d).select("seq", C.wal_crc(F.col("seq"), F.col("op"), F.col("key"), F.col("value")).alias("crc")),
    "kv_bloom_bits": lambda s, d: R.bloom_bits(_runs(s, d)),
}

_LOG = """log AS (SELECT event_id + 1 AS seq, CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS op,
  printf('user%06d', user_id) AS key, CASE WHEN event_type <> 'error' THEN event_type || '|' || props END AS value,
  CAST(event_id // 250 AS BIGINT) AS run FROM events)"""
_LATEST = "latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"
_FLUSHED = "flushed AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) = 1)"
_LIVE = "live AS (SELECT key, value, seq FROM latest WHERE op = 0)"
_BYTES = "strlen(key) + coalesce(strlen(value), 0)"


def _in(keys) -> str:
    return ", ".join(f"('{k}')" for k in keys)


ORACLE = {
    "kv_log": f"WITH {_LOG} SELECT seq, op, key, value FROM log",
    "kv_latest": f"WITH {_LOG}, {_LATEST} SELECT key, op, value, seq FROM latest",
    "kv_live": f"WITH {_LOG}, {_LATEST}, {_LIVE} SELECT * FROM live",
    "kv_get": f"WITH {_LOG}, {_LATEST}, {_LIVE} SELECT key, value FROM live WHERE key = 'user000007'",
    "kv_multi_get": f"WITH {_LOG}, {_LATEST}, {_LIVE}, p(key) AS (VALUES {_in(PROBES)}) "
                    "SELECT p.key, live.key IS NOT NULL AS found, live.value FROM p LEFT JOIN live ON p.key = live.key",
    "kv_scan": f"WITH {_LOG}, {_LATEST}, {_LIVE} SELECT key, value FROM live WHERE key BETWEEN 'user000003' AND 'user000010' ORDER BY key",
    "kv_seek": f"WITH {_LOG}, {_LATEST}, {_LIVE} SELECT key, value FROM live WHERE key >= 'user000003' ORDER BY key LIMIT 1",
    "kv_scan_limit": f"WITH {_LOG}, {_LATEST}, {_LIVE} SELECT key, value FROM live WHERE key >= 'user000005' ORDER BY key LIMIT 3",
    "kv_snapshot": f"WITH {_LOG}, latest AS (SELECT * FROM log WHERE seq <= 500 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1), "
                   f"{_LIVE} SELECT * FROM live",
    "kv_run_flush": f"WITH {_LOG}, {_FLUSHED} SELECT run, key, op, value, seq FROM flushed",
    "kv_run_merge": f"WITH {_LOG}, {_LATEST} SELECT key, op, value FROM latest",
    "kv_compact": f"WITH {_LOG}, {_LATEST}, {_LIVE} SELECT * FROM live",
    "kv_compact_prefix": f"WITH {_LOG}, {_LATEST}, {_LIVE} SELECT * FROM live",
    "kv_run_meta": f"WITH {_LOG}, {_FLUSHED} SELECT run, count(*) AS n, CAST(sum(op) AS BIGINT) AS tombstones, min(key) AS min_key, "
                   f"max(key) AS max_key, max(seq) AS max_seq, CAST(sum({_BYTES}) AS BIGINT) AS net_bytes FROM flushed GROUP BY run",
    "kv_sst_index": f"WITH {_LOG}, {_FLUSHED}, sized AS (SELECT run, key, CAST(7 + {_BYTES} AS BIGINT) AS rec_size FROM flushed) "
                    "SELECT run, key, CAST(coalesce(sum(rec_size) OVER (PARTITION BY run ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING "
                    "AND 1 PRECEDING), 0) AS BIGINT) AS rec_offset, rec_size FROM sized",
    "kv_candidate_runs": f"WITH {_LOG}, p(key) AS (VALUES {_in(BLOOM_PROBES)}) SELECT DISTINCT run, key FROM log JOIN p USING (key)",
    "kv_log_gaps": f"WITH {_LOG}, g AS (SELECT lag(seq) OVER (ORDER BY seq) AS last, seq AS next FROM log WHERE op = 0) "
                   "SELECT last, next, next - last - 1 AS missing FROM g WHERE next > last + 1",
    "kv_orphan_wal": f"WITH {_LOG} SELECT DISTINCT run FROM log WHERE run % 2 <> 0",
    "kv_wal_recover": f"WITH {_LOG}, good AS (SELECT * FROM log WHERE seq < coalesce((SELECT min(seq) FROM log WHERE seq >= 400 AND "
                      "value LIKE '%\"k\": 0}'), 9223372036854775807)), latest AS (SELECT * FROM good QUALIFY row_number() OVER "
                      f"(PARTITION BY key ORDER BY seq DESC) = 1), {_LIVE} SELECT * FROM live",
    "kv_filenames": f"WITH {_LOG} SELECT DISTINCT run, printf('%06d.wal', run) AS wal, printf('%06d.sst', run) AS sst, run AS parsed FROM log",
    "kv_memtable_size": f"WITH {_LOG}, {_FLUSHED} SELECT run, CAST(sum({_BYTES}) AS BIGINT) AS net_bytes FROM flushed GROUP BY run",
}

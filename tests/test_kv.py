"""The log, its views and runs, on fixtures and against SQL over the smallest tables."""

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandlog.functions import checksums as C
from strandlog.log import deletes, numbered, puts, validated
from strandlog.operators import runs as R
from strandlog.operators import views as V
from strandlog.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
LOG = "seq long, op int, key string, value string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def log(spark, *muts):
    return spark.createDataFrame([(i + 1, 1 if v is None else 0, k, v) for i, (k, v) in enumerate(muts)], LOG)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events",):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    want = want[cols].astype(object).where(want[cols].notna(), None)
    assert rows(got.select(*cols)) == sorted(map(tuple, want.itertuples(index=False)), key=repr)


def test_all_queries_registered(spark):
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_put_get_delete(spark):
    m = log(spark, ("key1", "a"), ("to_del", "x"), ("key1", "b"), ("to_del", None), ("empty", ""))
    assert rows(V.get(m, "key1")) == [("key1", "b")]
    assert rows(V.get(m, "to_del")) == []
    assert rows(V.get(m, "empty")) == [("empty", "")]
    keys = spark.createDataFrame([("key1",), ("to_del",), ("none",)], "key string")
    assert rows(V.multi_get(m, keys)) == [("key1", True, "b"), ("none", False, None), ("to_del", False, None)]


def test_scan_is_inclusive_and_ordered(spark):
    m = log(spark, ("a3", "3"), ("a1", "1"), ("a2", "2"), ("", "e"), ("a2", None))
    assert [tuple(r) for r in V.scan(m, "a1", "a3").collect()] == [("a1", "1"), ("a3", "3")]
    assert V.scan(m, "b", "a").count() == 0
    assert [r.key for r in V.scan(m).collect()] == ["", "a1", "a3"]
    assert V.seek(m, "a2").first().key == "a3"
    assert list(V.cursor(m, "a1")) == [("a1", "1"), ("a3", "3")]


def test_snapshot_keeps_old_view(spark):
    m = log(spark, ("a1", "v1"), ("a2", "v2"), ("a1", None))
    assert [r.key for r in V.scan(V.as_of(m, 2)).collect()] == ["a1", "a2"]
    assert [r.key for r in V.scan(m).collect()] == ["a2"]


def test_delete_in_newer_run_hides_older_put(spark):
    m = log(spark, ("k", "old"), ("j", "1"), ("k", None)).withColumn("run", F.col("seq") - 1)
    flushed = R.flush(m)
    assert flushed.count() == 3
    assert rows(R.compact(flushed).select("key")) == [("j",)]
    assert rows(V.live(R.compact_prefix(flushed, 2)).select("key")) == [("j",)]


def test_invalid_mutations(spark):
    with pytest.raises(Exception, match="NULL"):
        puts(spark.createDataFrame([("k", None)], "key string, value string")).collect()
    with pytest.raises(Exception, match="invalid mutation"):
        validated(spark.createDataFrame([(1, 0, None, "v")], LOG)).collect()
    assert deletes(spark.createDataFrame([("k",)], "key string")).first().op == 1


def test_numbered_is_dense(spark):
    got = numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")), "x", after=5)
    assert [r.seq for r in got.orderBy("x").collect()] == list(range(6, 1006))


def test_golden_checksums(spark):
    df = spark.createDataFrame([("apple",), ("persistent-key",), ("123456789",), ("",)], "k string")
    got = {r[0]: r[1] & (2**64 - 1) for r in df.select("k", C.crc64_iso(F.col("k"))).collect()}
    assert got["apple"] == 0x32DEFEBEA4200000 and got["persistent-key"] == 0x689F39830FB161C8 and got["123456789"] == 0xB90956C775A41001
    bits = df.where("k = 'apple'").select(C.bloom_positions(F.col("k"), F.lit(1000).cast("long"))).first()[0]
    assert bits == [576, 582, 292, 298, 304, 310, 316]


def test_golden_log_record(spark):
    df = spark.createDataFrame([(0, 0, "user:1", "alice"), (2, 1, "user:1", None)], LOG)
    got = {r[0]: r[1] for r in df.select("seq", C.wal_crc(F.col("seq"), F.col("op"), F.col("key"), F.col("value"))).collect()}
    assert got == {0: 1934377171, 2: 826996312}
    assert zlib.crc32(b"123456789") == 3421780262


def test_bloom_has_no_false_negatives(spark):
    m = log(spark, *[(f"key_{i}", "v") for i in range(200)]).withColumn("run", F.lit(0).cast("long"))
    probes = spark.createDataFrame([(f"key_{i}",) for i in range(200)] + [("other",)], "key string")
    assert R.candidate_runs(m, probes).count() == 200


@pytest.mark.parametrize("cell", [3, 10, 1 << 20])
def test_log_gaps(spark, cell):
    seqs = [1, 2, 2, 5, 6, 20, None, 21, 40]
    log = spark.createDataFrame([(s,) for s in seqs], "seq long")
    got = sorted(tuple(r) for r in R.log_gaps(log, cell).select("last", "next", "missing").collect())
    assert got == [(2, 5, 2), (6, 20, 13), (21, 40, 18)]
    assert R.log_gaps(log.limit(0), cell).count() == 0

"""The persistent table, streaming ingest and the binary layouts."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from strandlog.sources import codec
from strandlog.streaming.ingest import ingest
from strandlog.table import Conflict, Options, Table

WAL = bytes.fromhex("d3404c73000000000000000000060005000000757365723a31616c696365f6bf341b000100000000000000060003000000757365723a32626f62"
                    "58f64a31010200000000000000060000000000757365723a31")
RUN_CRC = 3257632972


def kv(spark, rows):
    return spark.createDataFrame(rows, "key string, value string")


def content(table):
    return {r.key: r.value for r in table.scan().collect()}


def test_random_model(spark, tmp_path):
    rng, model = random.Random(4), {}
    table = Table(spark, f"file://{tmp_path}/t", Options(compact_at=3, partitions=2))
    assert content(table) == {}
    for step in range(5):
        rows = [(i, int(rng.random() < 0.3), f"k{rng.randint(0, 15)}", f"v{step}.{i}") for i in range(12)]
        df = spark.createDataFrame(rows, "i long, op int, key string, value string").withColumn("value", F.when(F.col("op") == 0, F.col("value")))
        table.apply(df, "i")
        for _, op, k, v in rows:
            model.pop(k, None) if op else model.update({k: v})
        assert content(table) == model
        table.maybe_compact()
        assert content(table) == model
    assert content(Table(spark, f"file://{tmp_path}/t")) == model


def test_snapshots_conflicts_and_vacuum(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a = Table(spark, path, Options(partitions=1)).put(kv(spark, [("a", "1"), ("b", "")]))
    old, late = Table(spark, path), Table(spark, path)
    a.delete(kv(spark, [("a", None)]).select("key"))
    assert content(old) == {"a": "1", "b": ""} and content(a) == {"b": ""}
    assert a.get("a").count() == 0 and a.seek("a").first().key == "b"
    with pytest.raises(Conflict):
        late.put(kv(spark, [("z", "9")]))
    a.compact()
    assert content(Table(spark, path, version=1)) == {"a": "1", "b": ""}
    assert len(a.vacuum()) == 2 and content(Table(spark, path)) == {"b": ""}


def test_stream_is_idempotent(spark, tmp_path):
    spark.createDataFrame([(1, 0, "a", "1"), (2, 0, "b", "2"), (3, 1, "a", None)], "i long, op int, key string, value string").write.parquet(f"{tmp_path}/in")
    path = f"file://{tmp_path}/t"
    source = spark.readStream.schema("i long, op int, key string, value string").parquet(f"{tmp_path}/in")
    ingest(source, path, f"{tmp_path}/c1", "i", options=Options(partitions=1)).awaitTermination()
    table = Table(spark, path)
    assert content(table) == {"b": "2"}
    version = table.version
    ingest(source, path, f"{tmp_path}/c2", "i", options=Options(partitions=1)).awaitTermination()  # the same batch id once more
    assert Table(spark, path).version == version


def test_golden_log(spark, tmp_path):
    rows = [(0, 0, b"user:1", b"alice"), (1, 0, b"user:2", b"bob"), (2, 1, b"user:1", None)]
    assert codec.encode_log(rows) == WAL and list(codec.decode_log(WAL)) == rows
    broken = bytearray(WAL)
    broken[45] ^= 1
    assert list(codec.decode_log(bytes(broken))) == rows[:1]
    for cut in (31, 40, 57):
        assert list(codec.decode_log(WAL[:cut])) == rows[:1]
    (tmp_path / "000001.wal").write_bytes(WAL)
    (tmp_path / "000002.wal").write_bytes(b"")
    got = codec.read_logs(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, r.op, bytes(r.key), r.value and bytes(r.value)) for r in got] == rows


def test_golden_run(spark, tmp_path):
    rows = [(b"apple", b"red"), (b"banana", b"yellow"), (b"cherry", None), (b"date", b"brown"), (b"elderberry", b"purple")]
    data = codec.encode_run(rows, 5)
    assert len(data) == 224 and zlib.crc32(data) == RUN_CRC
    assert codec.decode_run(data) == (5, rows)
    with pytest.raises(ValueError):
        codec.decode_run(bytes(22))
    (tmp_path / "000001.sst").write_bytes(data)
    assert codec.read_runs(spark, str(tmp_path)).where("op = 1").first().key == b"cherry"


def test_dead_writer_is_settled(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    Table(spark, path, Options(partitions=1)).put(kv(spark, [("a", "1")]))
    dead = Table(spark, path, Options(partitions=1))
    with pytest.MonkeyPatch.context() as m:  # dies after its claim, before its manifest has a name
        rename = dead.files.fs.rename
        m.setattr(dead.files, "fs", type("Fs", (), {"__getattr__": lambda _, n: (lambda *a: 1 / 0) if n == "rename" else getattr(Table(spark, path).files.fs, n)})())
        with pytest.raises(ZeroDivisionError):
            dead.put(kv(spark, [("b", "2")]))
    assert rename and Table(spark, path).version == 1
    after = Table(spark, path, Options(partitions=1, retries=1)).put(kv(spark, [("c", "3")]))
    assert after.version == 3 and content(after) == {"a": "1", "b": "2", "c": "3"}


def test_compaction_keeps_newer_runs(spark, tmp_path):
    path, seen = f"file://{tmp_path}/t", []
    options = Options(partitions=1, retries=2, notify=lambda what, run: seen.append((what, run["n"])))
    a = Table(spark, path, options).put(kv(spark, [("a", "1"), ("b", "2")]))
    a.delete(kv(spark, [("b", None)]).select("key"))
    b = Table(spark, path, options).put(kv(spark, [("a", "9"), ("d", "4")]))
    a.compact()
    assert len(a.manifest["runs"]) == 2 and content(a) == {"a": "9", "d": "4"} == content(Table(spark, path))
    late = Table(spark, path, options, version=b.version).put(kv(spark, [("e", "5")]))
    assert content(late) == {"a": "9", "d": "4", "e": "5"}
    assert seen == [("flush", 2), ("flush", 1), ("flush", 2), ("compact", 1), ("flush", 1)]
    spark.range(1).write.parquet(f"{tmp_path}/t/runs/lost")
    assert "runs/lost" not in late.vacuum() and "runs/lost" in late.vacuum(grace=0) and content(Table(spark, path)) == content(late)


def test_recover_folder(spark, tmp_path):
    from strandlog.plans.recovery import recover_folder

    rows = [(0, 1, 0, b"a", b"1"), (0, 2, 0, b"b", b"2"), (1, 3, 1, b"a", None), (1, 4, 0, b"\xff\x00", b""), (2, 5, 0, b"b", b"5"), (2, 6, 0, b"c", b"6"),
            (3, 7, 0, b"d", b"7"), (4, 8, 0, b"e", b"8")]
    df = spark.createDataFrame(rows, "run long, seq long, op int, key binary, value binary")
    path = f"file://{tmp_path}"
    assert codec.save_files(codec.encoded(df, "wal").where("name <> '000004.wal'"), path) == 4
    assert codec.save_files(codec.encoded(df.where("run IN (0, 1, 3, 4)"), "sst"), path) == 4
    data = (tmp_path / "000000.sst").read_bytes()
    assert codec.record(data, 1) == (b"b", b"2") and codec.may_hold(data, b"a")
    with pytest.raises(IndexError):
        codec.record(data, 2)

    def damage(name, data):
        (tmp_path / name).write_bytes(data)
        (tmp_path / f".{name}.crc").unlink()  # the file system's own checksum

    damage("000003.sst", b"torn")  # its log is there
    damage("000004.sst", b"torn")  # its log isn't
    damage("000002.wal", (tmp_path / "000002.wal").read_bytes()[:-1])  # the last record is cut
    got = recover_folder(spark, path)
    fates = {r.path[-10:]: (r.state, r.fate) for r in got.files.collect()}
    assert fates == {"000000.sst": ("whole", "kept"), "000001.sst": ("whole", "kept"), "000000.wal": ("whole", "redundant"), "000001.wal": ("whole", "redundant"),
                     "000002.wal": ("cut", "replayed"), "000003.sst": ("corrupt", "rebuilt"), "000003.wal": ("whole", "replayed"), "000004.sst": ("corrupt", "lost")}
    assert {bytes(r.key): bytes(r.value) for r in got.live().collect()} == {b"b": b"5", b"\xff\x00": b"", b"d": b"7"}
    assert got.last_seq() == 7
    with pytest.raises(ValueError):
        codec.encode_log([(1, 0, b"k" * 65_536, b"")])


def test_numbered_spreads_canonical_keys(spark):
    from strandlog.log import numbered

    df = spark.range(3000).select(F.format_string("user%06d", F.col("id")).alias("key"), F.lit("v").alias("value"))
    out = numbered(df, "key")
    assert [r.seq for r in out.orderBy("key").collect()] == list(range(1, 3001))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "substring(cast(key" in plan and ", 7, 6)" in plan  # after "user00", which all share

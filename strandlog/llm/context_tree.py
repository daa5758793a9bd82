"""Context-tree weighting over bytes: code length of texts under a model of the training texts.

Each byte is eight binary decisions; every decision has a tree of contexts of 0 to ``DEPTH`` earlier bytes whose
Krichevsky-Trofimov estimates are mixed across all depths, by the weights that the training counts give. All counts are
kept, exactly, in tables that grow with the corpus; nothing of that size goes to the driver or to all executors.

Texts lie in blocks of bounded size. A block's different keys (context and byte, or word) are sent as packed arrays, one
row per block and bucket, to where the bucket's keys of all blocks meet; the answers go back to the block the same way.
A bucket holds whole subtrees of two bytes, so only the nodes of no and of one byte are summed up on the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.language import held_out
from strandlog.llm.scratch import drop, saved
from strandlog.llm.words import IS_SPACE, LOWER, blocks, mixed, word_hashes, word_spans

DEPTH = 5
#: Bytes of a block, buckets, and partitions whose blocks meet in one task for a bucket.
BLOCK, BUCKETS, TOGETHER = 48_000_000, 256, 256
#: Bytes of texts, and keys, that are worked on at once: what a task holds beside its block follows them, not the texts.
CHUNK, SLICE = 1 << 18, 1 << 18
_WORD = np.int64(1 << 62)  # marks the keys of words; those of contexts have 48 bits
_END = np.int64(-0x61C8864680B583EB)  # the hash of the end token


def pieces(data: np.ndarray, offsets: np.ndarray):
    """(bytes, offsets, bytes of them that only lead, whether the end is in it): texts as they are, but one long text in
    pieces of about ``CHUNK`` bytes that end after white space (no word is cut), each led by ``DEPTH`` bytes of the one before."""
    a, end = 0, len(data)
    if len(offsets) > 2 or end <= CHUNK:
        yield data, offsets, 0, True
        return
    while a < end:
        b = a + CHUNK
        while b < end and not IS_SPACE[part := data[b : b + CHUNK]].any():
            b += CHUNK
        b = min(end, b + int(IS_SPACE[part].argmax()) + 1) if b < end else end
        lead = min(a, DEPTH)
        yield data[a - lead : b], np.array([0, b - a + lead]), lead, b == end
        a = b


def grams(data: np.ndarray, offsets: np.ndarray, lead: int = 0, last: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Keys (last byte first, then the byte itself) of all bytes and the end mark (0) of each text, and their text's row.
    Contexts before a text are zeros. lead, last: of a piece."""
    n = len(offsets) - 1
    size = len(data) + n * (DEPTH + 1)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    wide = np.zeros(size, np.int64)
    wide[np.arange(len(data)) + rows * (DEPTH + 1) + DEPTH] = data
    asked = np.ones(size, bool)
    for k in range(DEPTH):
        asked[offsets[:-1] + np.arange(n) * (DEPTH + 1) + k] = False
    key = wide.copy()
    for k in range(1, DEPTH + 1):
        key[k:] |= wide[:-k] << (8 * (DEPTH + 1 - k))
    own = slice(lead, None if last else -1)
    return key[asked][own], np.repeat(np.arange(n), np.diff(offsets) + 1)[own]


def tokens(data: np.ndarray, offsets: np.ndarray, lead: int = 0, last: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of an end per text, and their text's row. lead, last: of a piece."""
    data, offsets = data[lead:], np.maximum(offsets - lead, 0)
    starts, ends, rows = word_spans(data, offsets)
    n = len(offsets) - 1 if last else 0
    keys = np.concatenate((word_hashes(data, starts, ends), np.full(n, _END).view(np.uint64)))
    return (keys >> np.uint64(2)).view(np.int64) | _WORD, np.concatenate((rows, np.arange(n)))


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series after eight steps up."""
    low = np.zeros_like(x)
    for k in range(8):
        low += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - math.log(math.pi) - lgamma(a + b + 1)


def _levels(keys: np.ndarray, n: np.ndarray, top: int = 1):
    """For each bit: (bit values, [per depth top..DEPTH: node of each key, node ids, zeros, ones, log KT, log weighted])."""
    byte = keys & 255
    for level in range(8):
        prefix = (1 << level) | (byte >> (8 - level))
        bit = (byte >> (7 - level)) & 1
        depths = []
        for d in range(top, DEPTH + 1):
            ids, at = np.unique(((keys >> (8 * (DEPTH + 1 - d))) << 8) | prefix, return_inverse=True)
            a, b = np.bincount(at, n * (bit == 0), len(ids)), np.bincount(at, n * (bit == 1), len(ids))
            depths.append([at, ids, a, b, log_kt(a, b), None])
        depths[-1][5] = depths[-1][4]
        for above, below in zip(depths[-2::-1], depths[:0:-1]):
            parent = np.zeros(len(below[1]), np.int64)
            parent[below[0]] = above[0]
            above[5] = np.logaddexp(above[4], np.bincount(parent, below[5], len(above[1]))) - math.log(2)
        yield bit, depths


def two_byte_nodes(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node above, zeros, ones, log weighted probability), summed over the two-byte nodes below each one-byte node.

    keys: whole subtrees of two last bytes. A node above is its byte times 256 plus the bit prefix.
    """
    parts = []
    for _, d in _levels(keys, n, 2):
        _, ids, a, b, _, w = d[0]
        parts.append(((ids >> 16 << 8) | (ids & 255), a, b, w))
    ids, a, b, w = (np.concatenate(p) for p in zip(*parts))
    node, at = np.unique(ids, return_inverse=True)
    return node, *(np.bincount(at, x, len(node)) for x in (a, b, w))


def upper_nodes(below: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones, weight of the KT estimate) of the one-byte nodes, by byte * 256 + bit prefix, and of the root by bit
    prefix, from below(node, a, b, w), the sums of two_byte_nodes over all keys."""
    def weighed(size: int, at: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray):
        a, b, w = (np.bincount(at, x, size).astype(float) for x in (a, b, w))  # of nothing it is of integers
        kt = log_kt(a, b)
        return np.stack([a, b, np.exp(kt - np.logaddexp(kt, w))], 1), np.logaddexp(kt, w) - math.log(2)

    nodes, a, b, w = (below[c].to_numpy() for c in ("node", "a", "b", "w"))
    one, weights = weighed(1 << 16, nodes, a, b, w)
    every = np.arange(1 << 16)
    root, _ = weighed(256, every & 255, one[:, 0], one[:, 1], weights)
    return one, root


def predictions(keys: np.ndarray, n: np.ndarray, one: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Natural log probability of each key's byte after its context; keys: whole subtrees of two last bytes."""
    out = np.zeros(len(keys))
    byte = keys & 255
    last = keys >> (8 * DEPTH) << 8
    for level, (bit, depths) in enumerate(_levels(keys, n, 2)):
        p = None
        for at, _, a, b, kt, w in reversed(depths):
            est = (np.where(bit == 1, b[at], a[at]) + 0.5) / (a[at] + b[at] + 1)
            if p is None:
                p = est
            else:
                share = np.exp(kt - math.log(2) - w)[at]
                p = share * est + (1 - share) * p
        prefix = (1 << level) | (byte >> (8 - level))
        for a, b, share in (one[last | prefix].T, root[prefix].T):
            p = share * (np.where(bit == 1, b, a) + 0.5) / (a + b + 1) + (1 - share) * p
        out += np.log(p)
    return out


# -- packed arrays


def pack(x: np.ndarray) -> bytes:
    """64-bit integers as compressed byte planes."""
    return len(x).to_bytes(8, "little") + pa.compress(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpack(x: bytes | pa.Buffer) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    data = np.frombuffer(pa.decompress(x[8:], 8 * n, "zstd"), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(data.reshape(8, n).T).view(np.int64).reshape(n)


def pack_keys(x: np.ndarray) -> bytes:
    """Rising keys, by their differences."""
    return pack(np.diff(x, prepend=0))


def unpack_keys(x: bytes | pa.Buffer) -> np.ndarray:
    return np.cumsum(unpack(x))


def merged(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, rising, and the sums of their counts, from arrays of rising keys; a range of keys at a time."""
    out_k, out_c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ranges = -(-sum(len(k) for k in keys) // SLICE)
    pivots = np.sort(np.concatenate([k[:: max(1, len(k) // (4 * ranges))] for k in keys])) if ranges > 1 else np.zeros(0, np.int64)
    pivots = np.unique(pivots[np.arange(1, ranges) * len(pivots) // max(1, ranges)])
    at = [np.concatenate(([0], np.searchsorted(k, pivots), [len(k)])) for k in keys]
    for i in range(len(pivots) + 1):
        k, c = (np.concatenate([np.zeros(0, np.int64), *[x[a[i] : a[i + 1]] for x, a in zip(xs, at)]]) for xs in (keys, n))
        if not len(k):
            continue
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        out_k.append(k[first])
        out_c.append(np.add.reduceat(c, first))
    return np.concatenate(out_k), np.concatenate(out_c)


def bucket_of(keys: np.ndarray) -> np.ndarray:
    """A bucket for each key; contexts of the same two last bytes share it."""
    family = np.where(keys & _WORD != 0, keys, keys >> 32).astype(np.uint64)
    return (mixed(family) >> np.uint64(32)).astype(np.int64) % BUCKETS


class Book:
    """Values by key, for keys that are all in it: a table of places by leading bits of scattered keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        k = self._scattered(keys)
        order = np.argsort(k)
        self.keys, self.values = k[order], values[order]
        self.shift = np.uint64(64 - max(1, len(k).bit_length() + 1))
        self.starts = np.empty(1 << (64 - int(self.shift)), np.int32)
        lead = self.keys >> self.shift
        for a in range(0, len(self.starts), SLICE):
            part = self.starts[a : a + SLICE]
            part[:] = np.searchsorted(lead, np.arange(a, a + len(part), dtype=np.uint64))

    @staticmethod
    def _scattered(keys: np.ndarray) -> np.ndarray:
        return keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        k = self._scattered(np.ascontiguousarray(keys))
        at = self.starts[k >> self.shift]
        wrong = np.flatnonzero(self.keys[at] != k)
        while len(wrong):
            at[wrong] += 1
            wrong = wrong[self.keys[at[wrong]] != k[wrong]]
        return self.values[at]


# -- the corpus


def _blocked(batches):
    """The texts, each with its block; and for each block and bucket its different keys, with their counts in training texts."""
    place = TaskContext.get().partitionId()
    block, size, held = place << 20, 0, []

    def keys_out():
        keys, n = merged(*zip(*held))
        held.clear()
        bucket = bucket_of(keys).astype(np.int16)
        order = np.argsort(bucket, kind="stable")
        keys, n = keys[order], n[order]
        cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        some = np.flatnonzero(np.diff(cuts))
        for i in range(0, len(some), 64):
            part = some[i : i + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), block)), pa.nulls(len(part), kind), pa.nulls(len(part), pa.bool_()), pa.nulls(len(part), pa.string()),
                 pa.array(part.astype(np.int32)), pa.array([pack_keys(keys[cuts[j] : cuts[j + 1]]) for j in part], pa.binary()),
                 pa.array([pack(n[cuts[j] : cuts[j + 1]]) for j in part], pa.binary())], ["block", "k", "t", "x", "bucket", "keys", "n"])

    for batch in batches:
        kind = batch.column(0).type
        train = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
        for first, end, data, offsets in blocks(batch.column(2), CHUNK):
            if size and size + len(data) > BLOCK:
                yield from keys_out()
                block, size = block + 1, 0
            size += len(data)
            n = end - first
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), *(batch.column(i).slice(first, n) for i in range(3)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                 pa.nulls(n, pa.binary())], ["block", "k", "t", "x", "bucket", "keys", "n"])
            for piece in pieces(LOWER[data], offsets):
                for keyed in (grams, tokens):
                    keys, rows = keyed(*piece)
                    u, c = np.unique(keys.view(np.uint64) << np.uint64(1) | train[first + rows], return_counts=True)
                    held.append(((u >> np.uint64(1)).view(np.int64), c * (u & np.uint64(1)).view(np.int64)))
                if sum(len(k) for k, _ in held) > 3 * SLICE + 2 * len(held[0][0]):
                    held[:] = [merged(*zip(*held))]
    if held:
        yield from keys_out()


def _read(table: pa.Table, column: str, read) -> list[np.ndarray]:
    """The arrays of a column of binaries, which are not copied first."""
    return [read(x.as_buffer()) for x in table.column(column)]


def _together(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return merged(_read(table, "keys", unpack_keys), _read(table, "n", unpack))


def _seated(keys: DataFrame, *tables: DataFrame, by: str) -> list[DataFrame]:
    """The tables in a partition for each different value of ``by`` in ``keys``, by a column ``seat`` whose hash leads there.
    Should fewer hashes be met (a chance of n e^-40 for n values), some values share a seat."""
    spark = keys.sparkSession
    all_ = sorted(r[0] for r in keys.select(by).distinct().collect())
    n = max(1, len(all_))
    ids = spark.range(40 * n).groupBy(F.pmod(F.hash("id"), F.lit(n))).agg(F.min("id")).collect()
    seats = pa.table({by: pa.array(all_, pa.int64()), "seat": pa.array([ids[i % len(ids)][1] for i in range(len(all_))], pa.int64())})
    return [t.join(F.broadcast(spark.createDataFrame(seats)), by).repartition(n, "seat") for t in tables]


def score_texts(docs: DataFrame, train: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, train flag, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row.

    docs: the boolean column ``train`` marks the rows that the model learns from. A null text counts as empty: its only
    token is the end. Repeated rows and null keys are scored one by one. Without training rows every bit has probability
    one half. n_bytes and bits_per_byte count the end mark. Words are known by 62 bits of their hash.
    """
    kind = docs.schema[key].dataType.simpleString()
    lean = docs.select(F.col(key).alias("k"), F.coalesce(F.col(train), F.lit(False)).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    both = saved(lean.mapInArrow(_blocked, f"block long, k {kind}, t boolean, x string, bucket int, keys binary, n binary"))
    table = both.where("x IS NOT NULL").select("block", "k", "t", "x")
    salt = F.floor(F.shiftright("block", 20) / TOGETHER).alias("salt")
    asked = both.where("bucket IS NOT NULL").select("block", "bucket", salt, "keys", "n")

    def merge(g: pa.Table) -> pa.Table:
        keys, n = _together(g)
        return pa.table([g.column("bucket")[:1], pa.array([pack_keys(keys)], pa.binary()), pa.array([pack(n)], pa.binary())], ["bucket", "keys", "n"])

    def count(g: pa.Table) -> pa.Table:
        keys, n = _together(g)
        words = keys & _WORD != 0
        node, a, b, w = two_byte_nodes(keys[~words], n[~words]) if not words.all() else (np.zeros(0, np.int64), *[np.zeros(0)] * 3)
        one = pa.table([g.column("bucket")[:1], pa.array([pack_keys(keys)], pa.binary()), pa.array([pack(n)], pa.binary()),
                        pa.array([int(n[words].sum())]), pa.array([int((n[words] > 0).sum())])], ["bucket", "keys", "n", "total", "different"])
        below = pa.table([pa.array(x) for x in (node, a, b, w)], ["node", "a", "b", "w"])
        return pa.concat_tables([one, below], promote_options="default").select(["bucket", "keys", "n", "total", "different", "node", "a", "b", "w"])

    parts = asked.groupBy("bucket", "salt").applyInArrow(merge, "bucket int, keys binary, n binary")
    counts = saved(parts.groupBy("bucket").applyInArrow(
        count, "bucket int, keys binary, n binary, total long, different long, node long, a double, b double, w double"))
    stats = counts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("different"), F.lit(0))).first()
    total, different = int(stats[0]), int(stats[1])
    below = counts.where("node IS NOT NULL").groupBy("node").agg(*[F.sum(c).alias(c) for c in "abw"]).toPandas()  # 256 * 255 rows at most
    one, root = upper_nodes(below)

    def answer(_, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.binary(), pa.binary())], ["block", "keys", "v"])
        keys, n = _together(right)
        words = keys & _WORD != 0
        v = n.astype(np.float64)
        if not words.all():
            v[~words] = predictions(keys[~words], v[~words], one, root) / math.log(10)
        out = [v[np.searchsorted(keys, k)].tobytes() for k in _read(left, "keys", unpack_keys)]
        return pa.table([left.column("block"), left.column("keys"), pa.array(out, pa.binary())], ["block", "keys", "v"])

    salts = asked.select(F.col("salt").alias("place")).distinct()
    known = counts.where("bucket IS NOT NULL").select("bucket", "keys", "n").crossJoin(F.broadcast(salts))  # BUCKETS rows for each salt
    told = saved(asked.groupBy("bucket", "salt").cogroup(known.groupBy("bucket", "place")).applyInArrow(answer, "block long, keys binary, v binary"))
    drop(counts)

    def score(texts: pa.Table, entries: pa.Table) -> pa.Table:
        book = None
        if entries.num_rows:
            book = Book(np.concatenate(_read(entries, "keys", unpack_keys)), np.concatenate(_read(entries, "v", lambda x: np.frombuffer(x, np.float64))))
        del entries
        n_rows = texts.num_rows
        got = {c: np.zeros(n_rows) for c in ("n_tokens", "n_known", "base_score", "score", "n_bytes")}
        first = 0
        for chunk in texts.column("x").chunks:
            for at, end, data, offsets in blocks(chunk, CHUNK):
                at, end = first + at, first + end
                n = end - at
                got["n_bytes"][at:end] = np.diff(offsets) + 1
                for piece in pieces(LOWER[data], offsets):
                    keys, rows = grams(*piece)
                    got["score"][at:end] += np.bincount(rows, book[keys], n)
                    keys, rows = tokens(*piece)
                    c = book[keys]
                    got["n_tokens"][at:end] += np.bincount(rows, minlength=n)
                    got["n_known"][at:end] += np.bincount(rows, c > 0, n)
                    got["base_score"][at:end] += np.bincount(rows, np.log10((c + 1) / (total + different + 1)), n)
            first += len(chunk)
        return pa.table([texts.column("k"), texts.column("t"), pa.array(got["n_tokens"].astype(np.int64)), pa.array(got["n_known"].astype(np.int64)),
                         pa.array(np.full(n_rows, total, np.int64)), pa.array(got["base_score"]), pa.array(got["score"]),
                         pa.array(got["n_bytes"].astype(np.int64)), pa.array(-got["score"] * math.log2(10) / np.maximum(got["n_bytes"], 1))],
                        names=[key, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"])

    out = f"{key} {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    texts, entries = _seated(asked, table, told, by="block")  # a row for each block to the driver
    return texts.groupBy("seat").cogroup(entries.groupBy("seat")).applyInArrow(score, out)


def language_model_table(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row."""
    out = score_texts(docs.select("doc_id", "text", (~held_out(F.col("doc_id"), 7, 2)).alias("train")), "train")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")

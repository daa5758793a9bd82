"""Removal of long repeated byte strings by suffix arrays over shards that equal strings share.

Every window of ``size`` bytes belongs to the place of its least hashed gram, so equal windows belong to equal grams at
equal distance. Runs of windows of one place are segments. Segments whose gram occurs once are unique; equal segments are
collapsed before anything is compared (a group of copies costs one segment per place); what is left - different segments
around one gram - goes to shards by the gram. There windows whose hash stands alone are unique; of the others,
induced sorting and permuted common prefixes tell those that start elsewhere too. A gram with very many different segments would make one shard too large: its windows are
grouped by their hash instead, in all tasks, and give the same result. Only ranges go back to the texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.scratch import saved
from strandlog.llm.suffixes import repeated_starts
from strandlog.llm.words import blocks, mixed, word_hashes

_U = np.uint64
_PLACE = _U((1 << 24) - 1)


@dataclass(frozen=True)
class Repeats:
    """size: bytes of a string. gram: bytes of a gram. chunk: windows of a text looked at together. shard: bytes of a shard,
    about. many: different segments of a gram from which its windows are grouped by hash."""

    size: int = 400
    gram: int = 128
    chunk: int = 4_000_000
    shard: int = 1_500_000
    many: int = 8000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from running minima of blocks both ways."""
    n = len(x)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    grid = full.reshape(-1, width)
    left = np.minimum.accumulate(grid, 1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _segments(data: np.ndarray, offsets: np.ndarray, conf: Repeats):
    """(text, start in it, windows, gram hash, segment hash) of all segments of a block of texts."""
    empty = (np.zeros(0, np.int64),) * 5
    if len(data) < conf.size:
        return empty
    at = np.arange(len(data) - conf.gram + 1)
    h = word_hashes(data, at, at + conf.gram)
    least = _sliding_min((h & ~_PLACE) | at.astype(np.uint64), conf.size - conf.gram + 1)
    place = (least & _PLACE).astype(np.int64)
    rows = np.searchsorted(offsets, np.arange(len(place)), "right") - 1
    good = np.arange(len(place)) + conf.size <= offsets[rows + 1]
    key = np.where(good, place, -1)
    cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (rows[1:] != rows[:-1]))))
    n = np.diff(np.append(cut, len(key)))
    some = key[cut] >= 0
    cut, n = cut[some], n[some]
    if not len(cut):
        return empty
    gram = h[key[cut]]
    segment = mixed(word_hashes(data, cut, cut + n + conf.size - 1) ^ mixed(gram + (key[cut] - cut).astype(np.uint64)))
    return rows[cut], cut - offsets[rows[cut]], n, gram.view(np.int64), segment.view(np.int64)


def _find(batches, conf: Repeats):
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for first, end, data, offsets in blocks(batch.column(1)):
            if end - first == 1 and len(data) > conf.chunk:  # one long text: chunks that share all but one byte of a window
                parts = [(a, data[a : a + conf.chunk + conf.size - 1]) for a in range(0, len(data), conf.chunk)]
            else:
                parts = [(0, data)]
            for shift, part in parts:
                rows, start, n, gram, segment = _segments(part, offsets if len(parts) == 1 else np.array([0, len(part)]), conf)
                yield pa.RecordBatch.from_arrays([pa.array(ids[first + rows]), pa.array(start + shift), pa.array(n), pa.array(gram), pa.array(segment)],
                                                 names=["row", "start", "n", "gram", "segment"])


def _extract(batches, conf: Repeats):
    """The bytes of the wanted segments of each text, in batches of some megabytes."""
    names = ["gram", "segment", "c", "big", "x"]
    held, size = [], 0

    def out():
        cols = zip(*held)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=names)

    for batch in batches:
        for x, wanted in zip(batch.column(0), batch.column(1)):
            data = x.as_buffer()
            for w in wanted:
                start, n = w["start"].as_py(), w["n"].as_py()
                held.append((w["gram"].as_py(), w["segment"].as_py(), w["c"].as_py(), w["big"].as_py(), data.slice(start, n + conf.size - 1).to_pybytes()))
                size += n + conf.size
                if size > 2_000_000:
                    yield out()
                    held, size = [], 0
    if held:
        yield out()


def ranges(at: np.ndarray) -> list[dict]:
    """Runs of consecutive numbers as (first, last)."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return [{"a": int(a), "b": int(b)} for a, b in zip(at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)])]


def _hashes(xs: list[bytes], conf: Repeats) -> list[np.ndarray]:
    """Hashes of all windows of each segment, some segments at a time."""
    out = []
    for first, end, data, offsets in blocks(pa.array(xs, pa.binary())):
        at = np.arange(len(data) - conf.size + 1)
        h = word_hashes(data, at, at + conf.size)
        out += [h[a : b - conf.size + 1] for a, b in zip(offsets, offsets[1:])]
    return out


def _shard(g: pd.DataFrame, conf: Repeats) -> pd.DataFrame:
    """The windows of each segment that start elsewhere too.

    A window whose hash is alone in the shard can't repeat; the runs of the other windows, equal ones once, go into a
    suffix array, which compares their bytes.
    """
    g = g.sort_values(["gram", "segment"])
    xs, counts = [bytes(x) for x in g["x"]], g["c"].to_numpy()
    hashes = _hashes(xs, conf)
    _, at, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    total = np.bincount(at, np.repeat(counts, [len(h) for h in hashes]), len(n))
    cuts = np.cumsum([0] + [len(h) for h in hashes])
    runs: dict[bytes, int] = {}
    weight, owners = [], []
    for i, x in enumerate(xs):
        some = np.flatnonzero(total[at[cuts[i] : cuts[i + 1]]] > 1)
        for r in ranges(some):
            run = x[r["a"] : r["b"] + conf.size]
            k = runs.setdefault(run, len(runs))
            if k == len(weight):
                weight.append(0)
            weight[k] += counts[i]
            owners.append((i, r["a"], k))
    repeated = repeated_starts(list(runs), conf.size)
    for run, k in runs.items():
        if weight[k] > 1:
            repeated[k] = np.arange(len(run) - conf.size + 1)
    found = [[] for _ in xs]
    for i, a, k in owners:
        found[i].append(repeated[k] + a)
    return pd.DataFrame({"gram": g["gram"], "segment": g["segment"], "found": [ranges(np.concatenate(f)) if f else [] for f in found]})


def _windows(batches, conf: Repeats):
    """Each window of the segments of very common grams: its hash, and how many it counts for."""
    for batch in batches:
        gram, segment, c = (batch.column(i).to_numpy() for i in range(3))
        for first, end, data, offsets in blocks(batch.column(3), 1 << 17):
            at = np.arange(len(data) - conf.size + 1)
            row = np.searchsorted(offsets, at, "right") - 1
            inside = at + conf.size <= offsets[row + 1]
            at, row = at[inside], row[inside]
            h = word_hashes(data, at, at + conf.size).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(gram[first + row]), pa.array(segment[first + row]), pa.array(at - offsets[row]), pa.array(h), pa.array(c[first + row])],
                                             names=["gram", "segment", "i", "h", "c"])


def _cut(batches, conf: Repeats):
    """The bytes that are kept of each text, and their digest."""
    for batch in batches:
        kept, sizes, removed, spans, digests = [], [], [], [], []
        for x, found in zip(batch.column(0), batch.column(1)):
            data = np.frombuffer(x.as_buffer(), np.uint8)
            edges = np.zeros(len(data) + 1, np.int32)
            for r in found.as_py() or []:
                edges[r["a"]] += 1
                edges[r["b"] + conf.size] -= 1
            gone = np.cumsum(edges[:-1]) > 0
            rest = data[~gone].tobytes()
            kept.append(rest)
            sizes.append(len(data))
            removed.append(int(gone.sum()))
            spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            digests.append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(2), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
             pa.array(digests, pa.string())], names=["k", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", conf: Repeats = Repeats()) -> DataFrame:
    """(key, kept BINARY, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``.

    Each byte that a string of ``size`` bytes covers is removed if the string also starts anywhere else in any text of the
    input, the same one included; all copies go, the first too. A null text is an empty one. Rows are told apart by
    themselves, so repeated rows and null keys are texts of their own. An empty table gives an empty one.
    """
    lean = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("x"))
    table = saved(lean)  # written, so that row numbers stay
    occ = saved(table.select("row", "x").where(F.octet_length("x") >= conf.size).mapInArrow(
        lambda it: _find(it, conf), "row long, start long, n long, gram long, segment long"))
    segments = occ.groupBy("gram", "segment").agg(F.count("*").alias("c"), F.min(F.struct("row", "start", "n")).alias("at"))
    grams = segments.groupBy("gram").agg(F.count("*").alias("k"), F.sum("c").alias("total")).where("total > 1")
    repeated = saved(segments.join(grams, "gram").select("gram", "segment", "c", "k", "at.*"))
    # one segment only: all of its windows repeat
    whole = repeated.where("k = 1").select("gram", "segment", F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("n") - 1).alias("b"))).alias("found"))
    several = repeated.where("k > 1")
    wanted = several.groupBy("row").agg(F.collect_list(F.struct("gram", "segment", "c", (F.col("k") >= conf.many).alias("big"), "start", "n")).alias("w"))
    texts = saved(table.select("row", "x").join(wanted, "row").select("x", "w").mapInArrow(
        lambda it: _extract(it, conf), "gram long, segment long, c long, big boolean, x binary"))
    total = texts.where("NOT big").agg(F.sum(F.octet_length("x").cast("long"))).first()[0] or 0
    shards = max(1, -(-total // conf.shard))
    sorted_ = texts.where("NOT big").groupBy(F.pmod(F.xxhash64("gram"), F.lit(shards)).alias("shard")).applyInPandas(
        lambda g: _shard(g, conf), "gram long, segment long, found array<struct<a:long,b:long>>")
    windows = saved(texts.where("big").select("gram", "segment", "c", "x").mapInArrow(
        lambda it: _windows(it, conf), "gram long, segment long, i long, h long, c long"))
    twice = windows.groupBy("gram", "h").agg(F.sum("c").alias("n")).where("n > 1")
    common = windows.join(twice, ["gram", "h"]).groupBy("gram", "segment").agg(
        F.transform(F.sort_array(F.collect_list("i")), lambda i: F.struct(i.alias("a"), i.alias("b"))).alias("found"))
    found = saved(whole.unionByName(sorted_).unionByName(common).where(F.size("found") > 0))
    spans = occ.join(found, ["gram", "segment"]).select("row", F.explode(F.transform(
        "found", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b")))).alias("r"))
    per_row = spans.groupBy("row").agg(F.collect_list("r").alias("rs"))
    kind = docs.schema[key].dataType.simpleString()
    return table.join(per_row, "row", "left").select("x", "rs", "k").mapInArrow(
        lambda it: _cut(it, conf), f"k {kind}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("k", key)


def repeats_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    return without_repeats(docs).drop("kept")

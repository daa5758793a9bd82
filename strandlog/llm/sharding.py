"""Shards of near-equal size by vector bin packing over bytes, tokens and rows.

Equal texts form a group. Small groups are bundled by their hash into a fixed number of bundles; a group that alone
holds more than a bundle's share is an item of its own, and one that holds more than a whole shard is cut into pieces
by the hash of its keys. So the driver places a bounded number of items (at most ``bundles`` bundles and
``3 * bundles`` large groups, which have 3 * shards * pieces pieces more), whatever the corpus: each, largest first, goes where the
dot product of its vector with the shard's residual capacity is highest. No group is brought into one task: sizes are
combined before the shuffle and slots are numbered in fixed cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.scratch import saved, unused

WORD = "[^ \\t\\n\\x0B\\f\\r]++"


@dataclass(frozen=True)
class Packing:
    """shards: their number. bundles: items that small groups are dealt to. cells: numbering cells of each shard.
    pieces: of a shard's worth of one group that is cut. weights: of bytes, tokens and rows in the dot product."""

    shards: int = 16
    bundles: int = 4096
    cells: int = 256
    pieces: int = 32
    weights: tuple[float, float, float] = (8.0, 1.0, 1.0)


def place(vectors: np.ndarray, shards: int, weights) -> np.ndarray:
    """Shard of each item (rows of shares of the total): the highest dot product with residual capacity among shards
    where it fits, or among all if it fits nowhere. Largest items first; ties go to the lower item and shard."""
    w = np.sqrt(np.asarray(weights, float))
    v = vectors * w
    left = np.tile(w / shards, (shards, 1))
    out = np.zeros(len(v), np.int64)
    for i in np.lexsort((np.arange(len(v)), -(v * w).sum(1))):
        dots = left @ v[i]
        fits = (left >= v[i] - 1e-12).all(1)
        at = int(np.argmax(np.where(fits, dots, -np.inf) if fits.any() else dots))
        left[at] -= v[i]
        out[i] = at
    return out


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Packing = Packing()) -> DataFrame:
    """``docs`` with a struct column ``placed``: size (UTF-8 bytes plus 1), text_crc32, shard and slot (gapless from 0).

    A null text counts as an empty one. Repeated rows and null keys each get their own slot. An empty table stays empty.
    Columns of other names pass through; one named ``placed`` is an error.
    """
    if "placed" in docs.columns:
        raise ValueError("the table has a column named placed already")
    spark = docs.sparkSession
    g_, n_, pieces_, shards_, s_, c_, before_, inside_ = unused(docs, "_g", "_n", "_pieces", "_shards", "_s", "_c", "_before", "_inside")
    whole = F.coalesce(F.col(text), F.lit(""))
    sized = docs.withColumn("placed", F.struct(
        (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
        (F.regexp_count(whole, F.lit(WORD)) + 1).cast("long").alias("tokens"), F.xxhash64(whole).alias("g")))
    p = F.col("placed")
    groups = saved(sized.select(p["g"].alias("g"), p["size"].alias("b"), p["tokens"].alias("t")).groupBy("g").agg(
        F.sum("b").alias("b"), F.sum("t").alias("t"), F.count("*").alias("r")))
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "btr"]).first()
    total = np.maximum(np.array([total["b"], total["t"], total["r"]], float), 1.0)
    share = F.greatest(*[F.col(c) / F.lit(float(n)) for c, n in zip("btr", total)])
    big = groups.where(share > 1.0 / plan.bundles)
    small = groups.where(share <= 1.0 / plan.bundles).groupBy(F.pmod("g", F.lit(plan.bundles)).cast("int").alias("bundle")).agg(
        *[F.sum(c).alias(c) for c in "btr"])
    bundles, large = small.collect(), big.collect()  # at most bundles and 3 * bundles rows
    bundles.sort(key=lambda r: r["bundle"])
    large.sort(key=lambda r: r["g"])
    keys, vectors = [], []
    for r in bundles:
        keys.append((None, r["bundle"], 0, 1))
        vectors.append([r[c] / n for c, n in zip("btr", total)])
    # a group of more than a shard is cut into pieces of about a 32nd of a shard, and their rows are counted
    split = {r["g"]: min(r["r"], int(np.ceil(plan.pieces * plan.shards * max(r[c] / n for c, n in zip("btr", total))))) for r in large
             if r["r"] > 1 and max(r[c] / n for c, n in zip("btr", total)) * plan.shards > 1}
    row_hash = F.xxhash64(F.lit(17), F.col(key))
    piece_rows = {}
    if split:  # fewer than 3 * shards groups
        cuts = F.broadcast(spark.createDataFrame(list(split.items()), f"{g_} long, {n_} long"))
        counted = sized.join(cuts, p["g"] == F.col(g_)).groupBy(F.col(g_).alias("g"), F.pmod(row_hash, F.col(n_)).alias("k")).agg(F.count("*").alias("n"))
        piece_rows = {(r["g"], r["k"]): r["n"] for r in counted.collect()}
    for r in large:
        v = np.array([r[c] / n for c, n in zip("btr", total)])
        pieces = split.get(r["g"], 1)
        for k in range(pieces):
            keys.append((r["g"], None, k, pieces))
            vectors.append(v * (piece_rows.get((r["g"], k), 0) / r["r"]) if r["g"] in split else v)
    at = place(np.array(vectors).reshape(-1, 3), plan.shards, plan.weights)
    big_map = [(g, k, n, int(s)) for (g, _, k, n), s in zip(keys, at) if g is not None]
    small_map = [0] * plan.bundles
    for (g, b, _, _), s in zip(keys, at):
        if g is None:
            small_map[b] = int(s)
    table = spark.createDataFrame(big_map, "g long, k int, n int, shard int").groupBy(F.col("g").alias(g_)).agg(
        F.first("n").alias(n_), F.sort_array(F.collect_list(F.struct("k", "shard"))).alias(pieces_))
    bundle_shards = spark.createDataFrame([(small_map,)], f"{shards_} array<int>")
    found = (sized.join(F.broadcast(table), p["g"] == F.col(g_), "left").join(F.broadcast(bundle_shards), F.lit(True), "left"))
    shard = F.coalesce(F.get(F.col(pieces_), F.pmod(row_hash, F.col(n_).cast("long")).cast("int"))["shard"],
                       F.get(F.col(shards_), F.pmod(p["g"], F.lit(plan.bundles)).cast("int")))
    out = found.withColumn("placed", F.struct(p["size"], p["text_crc32"], shard.alias("shard"), p["g"].alias("g"),
                                              F.pmod(F.xxhash64(row_hash, p["g"]), F.lit(plan.cells)).cast("int").alias("cell"))).select(*docs.columns, "placed")
    counts = out.groupBy(p["shard"].alias("s"), p["cell"].alias("c")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("s").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("s").alias(s_), F.col("c").alias(c_), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(before_))  # shards * cells rows
    inside = F.row_number().over(Window.partitionBy(p["shard"], p["cell"]).orderBy(F.col(key), p["g"], p["size"]))
    numbered = out.withColumn(inside_, inside).join(
        F.broadcast(offsets), (p["shard"] == F.col(s_)) & (p["cell"] == F.col(c_)))
    return numbered.withColumn("placed", F.struct(
        p["size"], p["text_crc32"], p["shard"].cast("int").alias("shard"),
        (F.col(inside_) - 1 + F.col(before_)).cast("long").alias("slot"))).select(*docs.columns, "placed")


def shard_table(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Packing = Packing()) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row; the law is ``bytes``."""
    p = F.col("placed")
    return sharded(docs.select(key, text), key, text, plan).select(
        key, p["size"].alias("size"), p["text_crc32"].alias("text_crc32"), F.lit("bytes").alias("law"), p["shard"].alias("shard"),
        p["slot"].alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

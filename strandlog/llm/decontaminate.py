"""Benchmark items inside documents: size-partitioned MinHash containment search, verified by exact containment.

Items are partitioned by their number of shingles. A document that holds a share ``t`` of an item's shingles holds the
minimum of the item's shingles under a random order with probability ``t``, however long the document is; so an item
is a candidate when any of its partition's minima occurs in the document, and the partition's number of orders bounds
the chance of a miss by ``miss``. Items with few shingles are searched by all of them. Candidates are then verified by the
exact intersection of shingle sets. Items go to the executors in blocks of bounded size; documents are scanned whole
and never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.words import mixed, text_shingles

_U = np.uint64


@dataclass(frozen=True)
class Containment:
    """size: words of a shingle. percent: hundredths of an item's shingles that a document must hold. miss: bound on the
    chance that the search misses such a pair. block: shingles of items that one pass over the documents holds at most."""

    size: int = 5
    percent: int = 80
    miss: float = 1e-9
    block: int = 4_000_000

    def orders(self, low: int) -> int:
        """Minima that a size partition from ``low`` shingles on needs; all shingles do where there are fewer."""
        return min(low * 2, math.ceil(math.log(self.miss) / math.log(1 - self.percent / 100)))


class Index:
    """The items of one block: their shingle sets, and their minima sorted for lookup."""

    def __init__(self, conf: Containment, ids: np.ndarray, sets: list[np.ndarray]):
        self.conf, self.ids, self.sizes = conf, ids, np.array([len(s) for s in sets], np.int64)
        keys, owners = [], []
        for i, s in enumerate(sets):
            low = 1 << (len(s).bit_length() - 1)  # the size partition of low to 2 * low - 1 shingles
            k = conf.orders(low)
            found = s if k >= len(s) else np.unique(np.array([s[np.argmin(mixed(s ^ _U((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))] for j in range(k)]))
            keys.append(found)
            owners.append(np.full(len(found), i))
        self.minima, self.owners = _by_key(keys, owners)
        self.shingles, self.holders = _by_key(sets, [np.full(len(s), i) for i, s in enumerate(sets)])

    def hits(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items that a document's set holds, and the shared shingles of each."""
        none = np.zeros(0, np.int64)
        candidates = np.unique(_owners(held, self.minima, self.owners))
        if not len(candidates):
            return none, none
        shared = np.bincount(_owners(held, self.shingles, self.holders), minlength=len(self.sizes))[candidates]
        good = 100 * shared >= self.conf.percent * self.sizes[candidates]
        return candidates[good], shared[good]


def _by_key(keys: list[np.ndarray], owners: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, o = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(k, kind="stable")
    return k[order], o[order]


def _owners(held: np.ndarray, keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """The owners of all entries whose key is in ``held`` (distinct)."""
    low, high = np.searchsorted(keys, held, "left"), np.searchsorted(keys, held, "right")
    n = high - low
    some = n > 0
    low, n = low[some], n[some]
    at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    return owners[at]


def text_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of each text; empty without words."""
    for first, _, hashes, bounds in text_shingles(column, size):
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            yield first + i, np.unique(hashes[a:b])


def indexes(items: DataFrame, key: str, text: str, conf: Containment) -> Iterator[Index]:
    """The items in blocks, streamed through the driver one partition at a time. Items without words are never found."""
    ids, sets, held = [], [], 0
    for row in items.select(F.col(key).cast("long").alias("k"), F.col(text).alias("x")).where("x IS NOT NULL").toLocalIterator():
        for _, s in text_sets(pa.array([row["x"]], pa.large_string()), conf.size):
            if len(s):
                ids.append(-1 if row["k"] is None else row["k"])
                sets.append(s)
                held += len(s)
        if held >= conf.block:
            yield Index(conf, np.array(ids), sets)
            ids, sets, held = [], [], 0
    if sets:
        yield Index(conf, np.array(ids), sets)


def found_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                item_text: str = "text", conf: Containment = Containment()) -> DataFrame:
    """(key, item_id, n_shingles, n_shared, containment) for each document row and item that it holds.

    Words are lower-cased in A-Z. An item of fewer words than a shingle is held by documents of exactly these words.
    Null or wordless texts hold nothing and are held by nothing; null item keys come out as -1. Repeated rows of either
    table come out repeatedly.
    """
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, item_id long, n_shingles long, n_shared long, containment double"
    out = None
    for index in indexes(items, item_key, item_text, conf):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # at most conf.block shingles and one text more

        def search(batches, shared=shared):
            ix = shared.value
            for batch in batches:
                rows, which, n = [], [], []
                for row, s in text_sets(batch.column(1), conf.size):
                    items_, shared_ = ix.hits(s)
                    rows += [row] * len(items_)
                    which.append(items_)
                    n.append(shared_)
                if rows:
                    w, n = np.concatenate(which), np.concatenate(n)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array(ix.ids[w], pa.int64()), pa.array(ix.sizes[w]), pa.array(n, pa.int64()),
                         pa.array(np.round(n / ix.sizes[w], 6))], names=[key, "item_id", "n_shingles", "n_shared", "containment"])

        part = docs.select(key, text).mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
                   conf: Containment = Containment()) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns."""
    clean = docs
    at = docs.columns.index(text)
    for index in indexes(items, item_key, item_text, conf):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches, shared=shared):
            for batch in batches:
                good = np.ones(len(batch), bool)
                for row, s in text_sets(batch.column(at), conf.size):
                    good[row] = not len(shared.value.hits(s)[0])
                yield batch.filter(pa.array(good))

        clean = clean.mapInArrow(keep, docs.schema)
    return clean


ORACLE = """WITH w AS (SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') FROM benchmark),
s AS (SELECT DISTINCT kind, id, array_to_string(ws[i:i + 4], ' ') AS sh, least(len(ws), 5) AS n
  FROM (SELECT kind, id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
z AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, z.id AS item_id, any_value(z.n) AS n_shingles, count(*) AS n_shared, round(count(*) / any_value(z.n), 6) AS containment
FROM s d JOIN s i ON d.kind = 0 AND i.kind = 1 AND d.sh = i.sh AND d.n = i.n JOIN z ON z.id = i.id GROUP BY d.id, z.id
HAVING 100 * count(*) >= 80 * any_value(z.n)"""

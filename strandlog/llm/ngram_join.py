"""Similarity self-join of texts by Jaccard of word shingles, by token-combination prefixes.

A token is a shingle's hash. Tokens are ordered by how many documents their hash cell holds, rarest first, and fall into
three classes: rare tokens count alone, frequent ones only in pairs and very frequent ones only in triples of the same
token group (as in pkwise, Wang et al., SIGMOD 2016). A set's prefix in that order is extended until destroying all its
combinations takes more differing tokens than the threshold allows; so linked sets share a combination.

Phases, each written to the shared folder:

1. document counts of all cells (a fixed number, whatever the corpus), giving an order and a class to each;
2. one row per different set, with its signatures; copies of a set are collapsed before anything is compared;
3. buckets of equal signatures: each member is a candidate of one member of its bucket, the hub, verified exactly;
   the hub has then met all others and leaves. Sets that share a signature by chance become more with the corpus, so
   before sets are fetched, parity sketches (the bitmap filter of Sandes et al., 2020) rule out pairs that differ too
   much: the bits in which two sketches differ are never more than the tokens in which their sets do;
4. components of these links; where several components still meet in a bucket, one of them is the hub of the next
   turn, until the pairs that are left are few, and all of them are compared, in blocks, until a link is found. So a
   large group of near copies costs about one comparison per member and turn, and no link goes missing. Here too
   sketches rule out pairs first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.llm.components import components
from strandlog.llm.scratch import drop, saved
from strandlog.llm.words import mixed, text_shingles

_U = np.uint64


@dataclass(frozen=True)
class Order:
    """A level (0 to 255) for each cell, and the levels from which its tokens are of the second and third class."""

    level: np.ndarray
    frequent: int
    very_frequent: int

    def classes(self, levels: np.ndarray) -> np.ndarray:
        return (levels >= self.frequent).astype(np.uint8) + (levels >= self.very_frequent)


@dataclass(frozen=True)
class NgramJoin:
    """Words of a shingle, the threshold in hundredths, and sizes of the plan (they don't change the result).

    cell_bits: 2 ** cell_bits counters of the token order. frequent, very_frequent: documents by which a cell must exceed
    the mean cell and six times its spread for its tokens to be of the second and third class. block: sets compared with
    each other at once. hubs: that the buckets of one group choose from. turns: of hubs at most, before all pairs of
    components that still meet are compared; they are earlier when there are at most ``crowd`` of them for each member.
    """

    size: int = 4
    percent: int = 85
    cell_bits: int = 20
    frequent: int = 8
    very_frequent: int = 128
    block: int = 256
    hubs: int = 16
    turns: int = 1
    crowd: int = 64

    # -- pure functions of one set -------------------------------------------------------------------------------

    def prefix_signatures(self, tokens: np.ndarray, order: Order) -> np.ndarray:
        """Signatures of a set: its sorted distinct tokens, under the order of the cells.

        Token groups depend on the size class of the larger set of a pair; so a set that may have partners in larger
        size classes has signatures for those as well.
        """
        n = len(tokens)
        if not n or self._only_equal(n):
            return np.zeros(0, np.uint64)
        level = order.level[tokens >> _U(64 - self.cell_bits)]
        at = np.argsort(level, kind="stable")
        tokens, cls = tokens[at], order.classes(level[at])
        need = n - -(-self.percent * n // 100) + 1
        if cls[need - 1] == 0:
            return tokens[:need]
        first, last = n.bit_length() - 1, (100 * n // self.percent).bit_length() - 1
        return np.unique(np.concatenate([self._signatures(tokens, cls, need, c) for c in range(first, last + 1)]))

    def _only_equal(self, n: int) -> bool:
        """Whether a set of n tokens links with equal sets only, which are one row here."""
        return 100 * (n - 1) < self.percent * n and 100 * n < self.percent * (n + 1)

    def _groups(self, size_class: int) -> int:
        """Token groups of a size class; 0 where combinations could leave too few tokens to destroy.

        A group wastes one token in pairs and two in triples. The smaller set of a pair has at least percent of 2 ** size_class
        tokens, and percent of its own must outnumber the waste of all groups.
        """
        most = (self.percent**2 * (1 << size_class) // 10_000 - 1) // 3
        return min(max(1, (1 << size_class) * (100 - self.percent) // 300), most)

    def _signatures(self, tokens: np.ndarray, cls: np.ndarray, need: int, size_class: int) -> np.ndarray:
        groups = self._groups(size_class)
        if groups < 1:
            return tokens[:need]
        single = int(np.searchsorted(cls, 1))
        out, left = [tokens[: min(single, need)]], need - single
        held: dict[tuple[int, int], list[int]] = {}
        at = single
        while left > 0:
            key = (int(cls[at]), int(tokens[at] % _U(groups)))
            members = held.setdefault(key, [])
            members.append(int(tokens[at]))
            left -= len(members) > key[0]
            at += 1
        found = []
        for (k, _), members in held.items():
            for combo in combinations(sorted(members), k + 1):
                found.append(combo + (0,) * (2 - k))
        if found:
            c = np.array(found, np.uint64)
            out.append(mixed(mixed(mixed(c[:, 0]) + c[:, 1]) + c[:, 2] + _U(size_class)))
        return np.concatenate(out)

    def linked(self, shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * shared >= self.percent * (a + b - shared)

    def sketch(self, tokens: np.ndarray) -> bytes:
        """Parities of the tokens by their low bits: a power of two of bits, 256 or twice the tokens at least."""
        bits = max(256, 1 << (2 * len(tokens) - 1).bit_length())
        odd = np.bincount((tokens & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()

    def may_link(self, sketches: list[bytes], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the sets a and b of each pair may link, by sizes n and sketches; never False for linked ones."""
        length = np.array([len(x) for x in sketches])
        least, ok = np.minimum(length[a], length[b]), np.ones(len(a), bool)
        for size in np.unique(least):
            folded = np.zeros((len(sketches), size // 8), np.uint64)
            of = np.flatnonzero(least == size)
            for i in np.unique(np.concatenate((a[of], b[of]))):  # halves folded onto each other are the shorter sketch
                folded[i] = np.bitwise_xor.reduce(np.frombuffer(sketches[i], np.uint64).reshape(-1, size // 8), axis=0)
            step = max(1, (1 << 19) // (size // 8))
            for at in (of[k : k + step] for k in range(0, len(of), step)):
                differ = np.bitwise_count(folded[a[at]] ^ folded[b[at]]).sum(axis=1, dtype=np.int64)
                both = n[a[at]] + n[b[at]]
                ok[at] = 100 * (both - differ) >= self.percent * (both + differ)
        return ok

    # -- the corpus ----------------------------------------------------------------------------------------------

    def _sets(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        for first, counts, hashes, at in text_shingles(column, self.size):
            for i in range(len(counts)):
                yield first + i, np.unique(hashes[at[i] : at[i + 1]])

    def token_order(self, docs: DataFrame, text: str) -> Order:
        """The order of the cells, from document counts over the whole table: a fixed number of bytes on the driver."""
        bits, slices = self.cell_bits, 64
        schema = "slice int, counts binary"

        def packed(keys, rows):
            parts = [zlib.compress(x.tobytes(), 1) for x in rows]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

        def count(batches):
            cells = np.zeros(1 << bits, np.int64)
            for batch in batches:
                for _, tokens in self._sets(batch.column(0)):  # distinct in their document
                    np.add.at(cells, (tokens >> _U(64 - bits)).astype(np.int64), 1)
            yield packed(range(slices), cells.reshape(slices, -1))

        def add(table: pa.Table) -> pa.Table:
            total = np.zeros((1 << bits) // slices, np.int64)
            for x in table.column("counts"):
                total += np.frombuffer(zlib.decompress(x.as_buffer()), np.int64)
            return pa.Table.from_batches([packed([table.column("slice")[0].as_py()], [total])])

        parts = docs.select(text).mapInArrow(count, schema)
        # two levels, so that no task adds up more than some hundreds of tables
        level = parts.groupBy("slice", (F.spark_partition_id() % 64).alias("g"))
        summed = level.applyInArrow(lambda key, t: add(t), schema).groupBy("slice").applyInArrow(lambda key, t: add(t), schema)
        cells = np.zeros((slices, (1 << bits) // slices), np.int64)
        for row in summed.collect():
            cells[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
        return self.ordered(cells.reshape(-1))

    def ordered(self, cells: np.ndarray) -> Order:
        """Levels that rise with a cell's count: even shares of the cells below the first limit, steps of a quarter above."""
        usual = cells.mean() + 6 * cells.mean() ** 0.5
        limits = [int(usual + self.frequent), int(usual + max(self.frequent, self.very_frequent))]
        steps = np.quantile(cells, np.linspace(0, 1, 150)).astype(np.int64)
        steps = np.concatenate((steps[steps < limits[0]], limits, (limits[0] * 1.25 ** np.arange(1, 100)).astype(np.int64)))
        steps = np.unique(steps[steps <= max(limits[1], cells.max())])
        level = np.searchsorted(steps, cells).astype(np.uint8)  # steps below the count
        return Order(level, *(int(np.searchsorted(steps, x)) + 1 for x in limits))

    def digests(self, docs: DataFrame, key: str, text: str, order: Order) -> DataFrame:
        """(key, n, fp, sketch, sigs) of every row: set size, 128-bit fingerprint and sketch of the set, and signatures."""
        held = docs.sparkSession.sparkContext.broadcast(order)  # 2 ** cell_bits bytes

        def digest(batches):
            for batch in batches:
                n, fp, sketch, sigs = [], [], [], []
                for _, tokens in self._sets(batch.column(1)):
                    n.append(len(tokens))
                    fp.append(_fingerprint(tokens))
                    sketch.append(self.sketch(tokens))
                    sigs.append(self.prefix_signatures(tokens, held.value).view(np.int64))
                at = np.concatenate(([0], np.cumsum([len(x) for x in sigs]))).astype(np.int32)
                flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sketch, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(at), flat)], ["key", "n", "fp", "sketch", "sigs"])

        kind = dict(docs.dtypes)[key]
        return docs.select(key, text).mapInArrow(digest, f"key {kind}, n long, fp binary, sketch binary, sigs array<long>")

    def token_sets(self, docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
        """(id, tokens) of the wanted(id, key, fp) sets: the texts are read again instead of kept.

        A text is known by its key and its set's fingerprint, so rows with null or shared keys meet their own set only.
        """
        kind = dict(docs.dtypes)[key]

        def tagged(batches):
            for batch in batches:
                fps = [_fingerprint(tokens) for _, tokens in self._sets(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary()), batch.column(1)], ["key", "fp", "text"])

        texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tagged, f"key {kind}, fp binary, text string")
        wanted = wanted.select(F.col("key").alias("want"), F.col("fp").alias("want_fp"), "id")
        rows = texts.join(wanted, (F.col("fp") == F.col("want_fp")) & F.col("key").eqNullSafe(F.col("want"))).groupBy("id").agg(F.first("text").alias("text"))

        def make(batches):
            for batch in batches:
                sets = [tokens.tobytes() for _, tokens in self._sets(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "tokens"])

        return rows.mapInArrow(make, "id long, tokens binary")

    def verified(self, hubs: DataFrame, members: DataFrame | None, sets: DataFrame) -> DataFrame:
        """(u, v): for each pair of hubs(hub, other, hub_size, size), a linked pair of a member of one and of the other, if any.

        members(group, id), or None if each group is one set, of its id. Members of a hub and of all its others are dealt
        into blocks, and each block of one meets each block of the other in one place; a set is sent once per block that
        it meets.
        """
        blocks = lambda c: F.ceil(c / self.block).cast("int")
        load = hubs.groupBy("hub").agg(blocks(F.max("hub_size")).alias("nh"), blocks(F.sum("size")).alias("no"))
        of = lambda df, c: df.withColumn("id", F.col(c)) if members is None else df.join(members.withColumnRenamed("group", c), c)
        place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        hub_side = of(load, "hub").select("hub", place("nh").alias("i"), all_of("no").alias("j"), F.lit(0).alias("side"), F.col("hub").alias("grp"), "id")
        other_side = (of(hubs.join(load, "hub"), "other")
                      .select("hub", all_of("nh").alias("i"), place("no").alias("j"), F.lit(1).alias("side"), F.col("other").alias("grp"), "id"))
        rows = hub_side.union(other_side).join(sets, "id")
        cells = rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "side", "grp", "id")

        def compare(batches):
            place, held, found = None, None, []
            for batch in batches:
                ids, grps = batch.column("id").to_numpy(), batch.column("grp").to_numpy()
                sides, tokens = batch.column("side").to_numpy(), batch.column("tokens")
                places = zip(batch.column("hub").to_pylist(), batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True)
                for k, now in enumerate(places):
                    if now != place:
                        place, held, done = now, _Held(), None
                    mine = np.frombuffer(tokens[k].as_buffer(), np.uint64)
                    if sides[k] == 0:
                        held.add(ids[k], mine)
                    elif done != grps[k]:
                        hits = held.linked(mine, self)
                        if len(hits):
                            found.append((int(hits[0]), int(ids[k])))
                            done = grps[k]
                if found:
                    u, v = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
                    found = []

        return cells.mapInArrow(compare, "u long, v long")

    def components(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, n_shingles, component) of every row. See ``similar_components``."""
        order = self.token_order(docs, text)
        signed = saved(self.digests(docs, key, text, order))
        rows = saved(signed.select("key", "n", "fp"))
        sets = saved(signed.where("n > 0").groupBy("fp").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("sigs").alias("sigs"))
                     .withColumn("id", F.monotonically_increasing_id()))
        drop(signed)
        each = sets.select("id", "n", F.explode("sigs").alias("sig"))
        # most signatures stand alone: only those of several sets go on
        shared = each.groupBy("sig").agg(self._hub("id", 0), F.count("*").alias("size")).where("size > 1")
        found = saved(each.join(shared, "sig").withColumn("hub", F.col("hub").bitwiseXOR(self._turned(0))))
        sets, signed = saved(sets.select("id", "fp", "key", "n", "sketch")), sets
        drop(signed)
        stars = self._stars(found.where("id <> hub").select("hub", F.col("id").alias("other"), "n").distinct(), sets)
        stars = saved(stars.select("hub", "other", F.lit(1).alias("hub_size"), F.lit(1).alias("size")))
        met = saved(found.where("size > 2 AND id <> hub").select("sig", "id", "n"))
        drop(found)
        stage = self._linked_by(docs, key, text, sets, stars, None)
        for turn in range(1, self.turns + 2):
            named = met.join(stage, "id", "left").withColumn("component", F.coalesce("component", "id"))
            open_ = named.groupBy("sig", "component").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("id").alias("one"), F.count("*").alias("ids"))
            spread = open_.groupBy("sig").agg(self._hub("component", turn), F.min("component").alias("least"), F.count("*").alias("size")).where("size > 1")
            open_ = saved(open_.join(spread, "sig").withColumn("hub", F.col("hub").bitwiseXOR(self._turned(turn))))
            rows_, crowd = open_.agg(F.count("*"), F.avg(F.col("size") - 1) / 2).first()
            last = turn > self.turns or not rows_ or crowd <= self.crowd
            if last:
                pairs = self._component_pairs(open_.join(sets.select(F.col("id").alias("one"), "sketch"), "one"))
            else:
                pairs = open_.where("component <> hub").select(F.least("hub", "component").alias("a"), F.greatest("hub", "component").alias("b")).distinct()
                met, before = saved(named.join(open_.select("sig", "hub").distinct(), "sig").where("component <> hub").select("sig", "id", "n")), met
                drop(before)
            if rows_:
                stage = self._compared(docs, key, text, sets, saved(pairs), stage)
            drop(open_)
            if last:
                break
        drop(met)
        # back to the rows: the least key of all sets of a component
        tagged = sets.select("id", "fp", "key").join(stage, "id", "left").withColumn("component", F.coalesce("component", "id"))
        least = tagged.groupBy("component").agg(F.min("key").alias("least"))
        named = saved(tagged.join(least, "component").select("fp", "least"))
        drop(sets, stage)
        out = rows.join(named, "fp", "left")
        return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"),
                          F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key")).alias("component_id"))

    def _turned(self, turn: int) -> Column:
        """A number for the bucket of a row; ids are ordered after an exclusive or with it, so hubs change with turn and bucket."""
        return F.xxhash64(F.lit(turn), F.pmod("sig", F.lit(self.hubs)))

    def _hub(self, id_: str, turn: int) -> Column:
        return F.min(F.col(id_).bitwiseXOR(self._turned(turn))).alias("hub")

    def _stars(self, stars: DataFrame, sets: DataFrame) -> DataFrame:
        """Those (hub, other) of stars(hub, other, n) that may be linked, by their sizes and sketches."""
        of_hub = sets.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch"))
        near = stars.join(of_hub, "hub").where(self.percent * F.greatest("n", "hub_n") <= 100 * F.least("n", "hub_n"))
        both = near.join(sets.select(F.col("id").alias("other"), "sketch"), "other").select("hub", "other", "hub_n", "n", "hub_sketch", "sketch")

        def may(batches):
            for batch in batches:
                for part in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                    sketches = [x for c in ("hub_sketch", "sketch") for x in part.column(c).to_pylist()]
                    n = np.concatenate([part.column(c).to_numpy() for c in ("hub_n", "n")])
                    at = np.arange(part.num_rows)
                    yield part.select(["hub", "other"]).filter(pa.array(self.may_link(sketches, n, at, at + part.num_rows)))

        return both.mapInArrow(may, "hub long, other long")

    def _linked_by(self, docs: DataFrame, key: str, text: str, sets: DataFrame, hubs: DataFrame, members: DataFrame | None, stage: DataFrame | None = None) -> DataFrame:
        """(id, component) after the links that hubs and members lead to (see ``verified``), and those of ``stage``."""
        ids = hubs.select(F.explode(F.array("hub", "other")).alias("id")).distinct() if members is None else members.select("id")
        tokens = saved(self.token_sets(docs, key, text, sets.join(ids, "id", "left_semi")))
        links = saved(self.verified(hubs, members, tokens))
        drop(hubs, tokens)
        edges = links if stage is None else links.union(stage.select(F.col("id").alias("u"), F.col("component").alias("v")))
        out = saved(components(edges))
        drop(links, *([] if stage is None else [stage]))
        return out

    def _compared(self, docs: DataFrame, key: str, text: str, sets: DataFrame, pairs: DataFrame, stage: DataFrame) -> DataFrame:
        """The stage after pairs(a, b) of components have been compared, the larger of each as the hub."""
        groups = pairs.select(F.explode(F.array("a", "b")).alias("group")).distinct()
        # a set that has no link yet is not in the stage, and its id is its component
        members = saved(groups.join(stage.select(F.col("component").alias("group"), "id"), "group", "left").select("group", F.coalesce("id", "group").alias("id")))
        size = members.groupBy("group").agg(F.count("*").alias("size"))
        sized = (pairs.join(size.select(F.col("group").alias("a"), F.col("size").alias("sa")), "a")
                 .join(size.select(F.col("group").alias("b"), F.col("size").alias("sb")), "b"))
        larger = F.col("sa") >= F.col("sb")
        hubs = saved(sized.select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("other"),
                                  F.greatest("sa", "sb").alias("hub_size"), F.least("sa", "sb").alias("size")))
        out = self._linked_by(docs, key, text, sets, hubs, members, stage)
        drop(pairs, members)
        return out

    def _component_pairs(self, members: DataFrame) -> DataFrame:
        """Different (a, b) components that meet in a bucket of members(sig, component, lo, hi, one, ids, sketch, size, least)
        and may be linked there: by their sizes, and, if each has ``one`` of its ids only in the bucket, by their sketches.

        Buckets of one least component, mostly those of one group, are in one place block by block, so that a pair that
        meets in many of them is looked at about once.
        """
        side, most = self.block, 2048
        n = F.ceil(F.col("size") / side).cast("int")
        own = F.pmod(F.xxhash64("component"), n).cast("int")
        who = F.when(F.col("ids") == 1, F.col("one")).otherwise(F.bitwise_not("component"))  # below zero for several ids
        dealt = members.withColumns({"n": n, "own": own, "who": who}).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        dealt = dealt.select("least", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "sig", "own", "component", "lo", "hi", "who", "sketch")
        cells = dealt.repartition("least", "i", "j").sortWithinPartitions("least", "i", "j", "sig", "own", "component")

        def meet(batches):
            place, rows, number, looked = None, [], {}, None

            def pairs():
                nonlocal number, looked
                if len(rows) < 2:
                    return None
                own, comp, lo, hi, who, sketch = zip(*rows, strict=True)
                own, comp, lo, hi, who = (np.array(x) for x in (own, comp, lo, hi, who))
                if len(number) + len(rows) > most or looked is None:  # pairs may be looked at again
                    number, looked = {}, np.zeros((max(most, len(rows)),) * 2, bool)
                at = np.array([number.setdefault(x, len(number)) for x in who.tolist()])
                a, b = np.triu_indices(len(rows), 1)
                ok = (comp[a] != comp[b]) & ~looked[at[a], at[b]] & (self.percent * lo[a] <= 100 * hi[b]) & (self.percent * lo[b] <= 100 * hi[a])
                if place[1] != place[2]:  # pairs inside one block have a cell of their own
                    ok &= own[a] != own[b]
                a, b = a[ok], b[ok]
                looked[at[a], at[b]] = looked[at[b], at[a]] = True
                single = np.flatnonzero((who[a] >= 0) & (who[b] >= 0))
                keep = np.ones(len(a), bool)
                keep[single] = self.may_link(sketch, lo, a[single], b[single])
                a, b = comp[a[keep]], comp[b[keep]]
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"]) if len(a) else None

            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in ("least", "i", "j", "sig", "own", "component", "lo", "hi", "who", "sketch")]
                for least, i, j, sig, *row in zip(*cols, strict=True):
                    now = least, i, j, sig
                    if now != place:
                        if (out := pairs()) is not None:
                            yield out
                        if place is None or now[:3] != place[:3]:
                            number, looked = {}, None
                        place, rows = now, []
                    rows.append(row)
            if (out := pairs()) is not None:
                yield out

        return cells.mapInArrow(meet, "a long, b long").distinct()


class _Held:
    """Sets of one block, looked up all at once."""

    def __init__(self):
        self.ids, self.sets, self.index = [], [], None

    def add(self, id_: int, tokens: np.ndarray) -> None:
        self.ids.append(id_)
        self.sets.append(tokens)

    def linked(self, tokens: np.ndarray, rule: NgramJoin) -> np.ndarray:
        if not self.ids:
            return np.zeros(0, np.int64)
        if self.index is None:
            sizes = np.array([len(x) for x in self.sets])
            flat = np.concatenate(self.sets)
            owners = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(flat, kind="stable")
            self.index = np.array(self.ids), sizes, flat[order], owners[order]
        ids, sizes, flat, owners = self.index
        lo, hi = np.searchsorted(flat, tokens, "left"), np.searchsorted(flat, tokens, "right")
        n = hi - lo
        total = int(n.sum())
        at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        shared = np.bincount(owners[at], minlength=len(sizes))
        return ids[rule.linked(shared, sizes, len(tokens))]


def _fingerprint(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _only(add, table: pa.Table) -> pa.Table:
    return pa.Table.from_batches(list(add(table.to_batches())))


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", **plan) -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``docs``.

    Two rows link when 100 * |A and B| >= percent * |A or B| over their sets of distinct word shingles (A-Z lower-cased;
    a text of fewer words has its whole sequence as its one shingle). component_id is the least key reachable by links.
    Rows without words, and null texts, have an empty set and link with nothing, so with themselves only; equal texts
    link; repeated rows are kept, each with its own output row; null keys never are a component's least key unless all
    its keys are null. Other columns are ignored. An empty table gives no rows.
    """
    return NgramJoin(**plan).components(docs, key, text)

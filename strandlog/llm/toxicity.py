"""Toxicity by the nearest labelled examples, under exact TF-IDF cosine from block-max inverted indexes.

Examples are distinct labelled texts. Every term of theirs is a dimension; document frequencies are counted over all
documents. Long texts drown a few insults in ordinary words, so a second index holds the same examples over only the
terms that separate the classes by their log-likelihood ratio over distinct learned texts; the similarity to an example
is the larger of both cosines. An index holds, per term, example postings in blocks with the largest weight of each; a
query accumulates its terms from the strongest bound down and skips blocks that can't lift an example into its nearest.
Words of queries are cut and numbered as arrays, and known terms told apart by 64 bits of their hash.
Similarity-weighted votes are calibrated by a logistic fit on the examples themselves, each scored without itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.llm.language import held_out
from strandlog.llm.scratch import drop, saved, unused
from strandlog.llm.words import mixed, word_hashes

STEM = 5
BATCH = 256  # texts whose common terms are looked up at once
BLOCK_CHARS, HASHED_CHARS = 1 << 19, 1 << 17  # of texts that are cut into words at once, and of words that are hashed at once
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Nearest:
    """labelled: labelled rows of a class that anything is learned from, about. terms: separating terms at most; the vectors
    over all terms know no limit. examples: distinct labelled texts of a class at most. k: votes, all named with the score. block: postings of an
    index block. whole: lists that hold one of so many examples or more are kept as a weight for each example. threshold: the score that predicts 1. min_llr, min_share: a separating term's log-likelihood ratio and
    share of toxic texts at least."""

    labelled: int = 20_000
    terms: int = 2000
    examples: int = 3000
    k: int = 15
    block: int = 64
    whole: int = 16
    threshold: float = 0.7
    min_llr: float = 12.0
    min_share: float = 0.8


def _counts(text: str) -> Counter:
    """The terms of a text and how often each stands in it: its lower-case words, and with "~" the stems of longer ones."""
    out = Counter(_WORD.findall(text.lower()))
    for w, n in list(out.items()):
        if len(w) > STEM:
            out[w[:STEM] + "~"] += n
    return out


def _known(place: dict[str, int], counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array(list(map(place.get, counts, repeat(-1))), np.int32)
    n = np.fromiter(counts.values(), np.int32, len(counts))[ids >= 0]
    return ids[ids >= 0], n


@cache
def _chars() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it may stand in a word, and 64 bits for hashes."""
    inside = np.zeros(0x110000, bool)
    every = np.arange(len(inside), dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")  # not a string for each
    for m in _WORD.finditer(every):
        inside[m.start() : m.end()] = True
    return inside, mixed(np.arange(1, len(inside) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _codes(texts: list[str]) -> np.ndarray:
    """The code points of the texts, with a line feed between two."""
    return np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


class Numbers:
    """The terms of many texts by number, without a string for each word: words are cut and hashed as arrays of code points.

    Terms are known by 64 bits of their hash; those of a stem are the complement of its letters'. ``counts`` gives what
    ``_known`` of ``_counts`` does, by number, but for a chance of about one in 2**64 / terms for each different unknown word.
    """

    def __init__(self, place: dict[str, int]):
        self.size = max(place.values(), default=-1) + 1
        stem = np.fromiter((t[-1:] == "~" for t in place), bool, len(place))
        ends = np.cumsum(np.fromiter(map(len, place), np.int64, len(place)) + 1) - 1
        starts = np.concatenate(([0], ends + 1))[:-1]
        codes, ends = _codes(list(place)), ends - stem
        hashes = np.zeros(len(place), np.uint64)
        for a, b in self._parts(starts):
            hashes[a:b] = word_hashes(codes[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a], _chars()[1])
        hashes[stem] = ~hashes[stem]
        order = np.argsort(hashes)
        self.hashes = np.append(hashes[order], np.uint64((1 << 64) - 1))
        self.ids = np.append(np.fromiter(place.values(), np.int32, len(place))[order], np.int32(-1))
        bits = len(place).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    @staticmethod
    def _parts(starts: np.ndarray) -> Iterator[tuple[int, int]]:
        a = 0
        while a < len(starts):
            b = int(np.searchsorted(starts, starts[a] + HASHED_CHARS))
            yield a, b
            a = b

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the term of each hash, or -1."""
        at = self.first[hashes >> self.shift]
        left = np.flatnonzero(self.hashes[at] < hashes)
        while len(left):
            at[left] += 1
            left = left[self.hashes[at[left]] < hashes[left]]
        return np.where(self.hashes[at] == hashes, self.ids[at], -1)

    def counts(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text, the numbers of its known terms in order, and how often each stands there."""
        held, size = [], 0
        for t in texts:
            held.append(t.lower())
            size += len(held[-1])
            if size >= BLOCK_CHARS:
                yield from self._block(held)
                held, size = [], 0
        if held:
            yield from self._block(held)

    def _block(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        codes = _codes(texts)
        inside, bits = _chars()
        edges = np.flatnonzero(np.diff(inside[codes], prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        rows = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
        found = [np.zeros(0, np.int64)]
        for a, b in self._parts(starts):
            s, e, row = starts[a:b] - starts[a], ends[a:b] - starts[a], rows[a:b]
            long = e - s > STEM
            stems = s[long]
            h = word_hashes(codes[starts[a] : ends[b - 1]], np.concatenate((s, stems)), np.concatenate((e, stems + STEM)), bits)
            h[len(s) :] = ~h[len(s) :]
            ids = self.of(h)
            found.append((np.concatenate((row, row[long])) * self.size + ids)[ids >= 0])
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        cuts = np.searchsorted(keys, np.arange(len(texts) + 1) * self.size)
        ids = (keys - np.repeat(np.arange(len(texts)) * self.size, np.diff(cuts))).astype(np.int32)
        n = n.astype(np.int32)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield ids[a:b], n[a:b]


def document_frequencies(docs: DataFrame, terms: list[str], text: str = "text") -> np.ndarray:
    """In how many rows each of ``terms`` stands; counted per task, so that only one number a term and task is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(Numbers({t: i for i, t in enumerate(terms)}))

    def count(batches):
        numbers = shared.value
        n = np.zeros(numbers.size, np.int64)
        for batch in batches:
            for ids, _ in numbers.counts(t for t in batch["x"] if isinstance(t, str)):
                n[ids] += 1
        at = np.flatnonzero(n)
        yield pd.DataFrame({"t": at, "n": n[at]})

    out = np.zeros(len(terms), np.int64)
    got = docs.select(F.col(text).alias("x")).mapInPandas(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toPandas()
    out[got["t"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    shared.destroy()
    return out


def _class_counts(rows: DataFrame) -> DataFrame:
    """(t, k, kt): in how many of the rows(x, y) of label 0 and of label 1 each term stands."""

    def count(batches):
        for batch in batches:
            seen: tuple[Counter, Counter] = Counter(), Counter()
            for x, y in zip(batch["x"], batch["y"]):
                seen[int(y)].update(set(_counts(x)))
            every = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"t": every, "k": [seen[0][t] for t in every], "kt": [seen[1][t] for t in every]})

    return rows.select("x", "y").mapInPandas(count, "t string, k long, kt long").groupBy("t").agg(F.sum("k").alias("k"), F.sum("kt").alias("kt"))


def _llr(k: Column, n: Column, kt: Column, nt: Column) -> Column:
    """Signed log-likelihood ratio of a term in kt of nt toxic and k of n other rows."""
    safe = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    rate = (k + kt) / (n + nt)
    full = safe(kt, nt * rate) + safe(k, n * rate) + safe(nt - kt, nt * (1 - rate)) + safe(n - k, n * (1 - rate))
    return F.when(kt / nt > k / n, 2 * full).otherwise(-2 * full)


class Index:
    """Normalised examples, twice: by term, as postings in falling weight, in blocks of which the first weight is the maximum;
    and by example, to finish the few that may be among the nearest. Terms that many examples hold have one weight for each
    example instead of postings."""

    def __init__(self, conf: Nearest, idf: dict[str, float], texts: Iterable[list[str] | dict[str, int] | tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        self.conf, self.labels = conf, labels.astype(float)
        self.terms, self.idf = {t: i for i, t in enumerate(idf)}, np.fromiter(idf.values(), float, len(idf))
        rows = [self.weigh(t) for t in texts]
        self.row_ids, self.row_w = (np.concatenate([np.zeros(0, d), *[r[k] for r in rows]]) for k, d in enumerate((np.int32, float)))
        sizes = np.array([len(r[0]) for r in rows], np.int64)
        del rows
        self.ends = np.concatenate(([0], np.cumsum(sizes)))
        of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.lexsort((of, -self.row_w, self.row_ids))
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(self.row_ids, minlength=len(idf)))))
        self.at, self.w = of[order], self.row_w[order]
        common = np.flatnonzero(np.diff(self.starts) * conf.whole >= max(len(sizes), 1))
        self.place = np.full(len(idf), -1, np.int32)
        self.place[common] = np.arange(len(common))
        self._fill()

    def _fill(self) -> None:
        common = np.flatnonzero(self.place >= 0)
        self.whole = np.zeros((len(common), len(self.labels)))
        for i, t in enumerate(common.tolist()):
            cut = slice(self.starts[t], self.starts[t + 1])
            self.whole[i, self.at[cut]] = self.w[cut]
        self._dense = np.zeros(len(self.idf))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("whole", "_dense")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fill()

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms of example i and their weights."""
        cut = slice(self.ends[i], self.ends[i + 1])
        return self.row_ids[cut], self.row_w[cut]

    def weigh(self, terms: list[str] | dict[str, int] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the known terms and their normalised weights, of terms with repeats, of their counts or of ``known``."""
        ids, n = terms if isinstance(terms, tuple) else self.known(terms if isinstance(terms, dict) else Counter(terms))
        v = (1 + np.log(n)) * self.idf[ids]
        return ids, v / max(float(v @ v) ** 0.5, 1e-300)

    def known(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the known terms and how often each stands there."""
        return _known(self.terms, counts)

    def vector(self, terms: list[str] | dict[str, int]) -> dict[str, float]:
        return self._named(*self.weigh(terms))

    def _named(self, ids: np.ndarray, w: np.ndarray) -> dict[str, float]:
        names = list(self.terms)
        return {names[i]: float(x) for i, x in zip(ids, w)}

    @property
    def vectors(self) -> list[dict[str, float]]:
        return [self._named(*self.row(i)) for i in range(len(self.labels))]

    def nearest(self, v: dict[str, float], without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine above zero (ties: the lower example) and their cosines, exactly."""
        known = [(self.terms[t], q) for t, q in v.items() if t in self.terms]
        return self.closest(np.array([i for i, _ in known], np.int64), np.array([q for _, q in known], float), without)

    def common(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms of some queries add to the cosine with each example."""
        some = np.zeros((len(queries), len(self.whole)))
        for row, (ids, q) in zip(some, queries):
            at = self.place[ids]
            row[at[at >= 0]] = q[at >= 0]
        return some @ self.whole

    def closest(self, ids: np.ndarray, q: np.ndarray, without: int = -1, sims: np.ndarray | None = None, group: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """As nearest, of numbered terms; ``sims`` is what their common terms add, if that is known.

        Common terms come first, then the others in growing groups, the strongest first; the k-th best sum so far is the floor.
        What an example lacks is at most the length of the terms to come, as examples are no longer than 1, plus the first
        weight of each skipped block. Blocks are skipped where all this can't lift more than the 2k best to the floor. Once
        so few can reach it that their own rows are shorter than the postings to come, only those are finished.
        """
        n, k, step = len(self.labels), self.conf.k, self.conf.block
        every = ids, q
        size = self.starts[ids + 1] - self.starts[ids]
        other = (size > 0) & (self.place[ids] < 0)
        sims = self.common([every])[0] if sims is None else sims
        if without >= 0:
            sims[without] = 0
        ids, q, size = ids[other], q[other], size[other]
        order = np.argsort(-q * self.w[self.starts[ids]], kind="stable")
        ids, q, size = ids[order], q[order], size[order]
        first = self.starts[ids]
        rest = np.sqrt(np.append(np.cumsum((q * q)[::-1])[::-1], 0.0))[1:]
        later = np.append(np.cumsum(size[::-1])[::-1], 0)
        floor, gap, missed, a, near = 0.0, 0.0, 0.0, 0, None
        while a < len(ids):
            b = min(len(ids), a + group)
            head = size[a:b].copy()
            for j in np.flatnonzero((head > step) & (rest[a:b] + missed < gap)).tolist():
                tops = q[a + j] * self.w[first[a + j] : first[a + j] + head[j] : step]
                keep = int((tops + rest[a + j] + missed >= gap).sum())
                if keep < len(tops):
                    head[j], missed = step * keep, missed + float(tops[keep])
            at = np.arange(int(head.sum())) + np.repeat(first[a:b] - np.cumsum(head) + head, head)
            sims += np.bincount(self.at[at], self.w[at] * np.repeat(q[a:b], head), n)
            if without >= 0:
                sims[without] = 0
            if n > k and (b < len(ids) or missed):
                beyond = max(0, n - 2 * k)
                best = np.partition(sims, (beyond, n - k))
                floor = float(best[n - k])
                gap = floor - float(best[beyond])
                if floor > 0:
                    near = np.flatnonzero(sims + (rest[b - 1] + missed) >= floor - 1e-9)
                    if b == len(ids) or (self.ends[near + 1] - self.ends[near]).sum() < later[b]:
                        break
            a, group, near = b, 2 * group, None
        if near is not None:
            near = near[near != without]
            sims = np.zeros(n)
            sims[near] = self._cosines(near, *every)
        at = np.flatnonzero(sims > 0)
        if len(at) > 4 * k:  # ties beyond 12 digits go by example, so leave room below the k-th
            at = at[sims[at] >= np.partition(sims, n - k)[n - k] - 1e-9]
        at = at[np.lexsort((at, -np.round(sims[at], 12)))][:k]
        return at, sims[at]

    def _cosines(self, rows: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The cosines of some examples, from their rows."""
        self._dense[ids] = q
        cuts = [slice(a, b) for a, b in zip(self.ends[rows].tolist(), self.ends[rows + 1].tolist())]
        out = np.array([self._dense[self.row_ids[c]] @ self.row_w[c] for c in cuts])
        self._dense[ids] = 0
        return out


def _numbers(every: dict[str, int], chosen: dict[str, int]) -> np.ndarray:
    """For each number of ``every`` its term's number in ``chosen``, or -1."""
    out = np.full(len(every), -1, np.int32)
    out[[every[t] for t in chosen]] = list(chosen.values())
    return out


def _only(also: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ids = also[known[0]]
    return ids[ids >= 0], known[1][ids >= 0]


class Examples:
    """The same examples over all of their terms and over the separating ones; an example's similarity is the larger cosine."""

    def __init__(self, conf: Nearest, every: Index, chosen: Index, keys: list[int | None]):
        self.conf, self.every, self.chosen, self.labels, self.keys = conf, every, chosen, every.labels, keys
        self.also, self.numbers = _numbers(every.terms, chosen.terms), Numbers(every.terms)
        self.slope, self.shift = 1.0, 0.0

    def nearest(self, every: list[tuple], chosen: list[tuple], without: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The k most similar examples of each query; each is among the k nearest of the index that gives its larger cosine."""
        for a in range(0, len(every), BATCH):
            part = slice(a, a + BATCH)
            sums = [ix.common(v[part]) for ix, v in ((self.every, every), (self.chosen, chosen))]
            for e, c, out, se, sc in zip(every[part], chosen[part], without[part], *sums):
                near = self.every.closest(*e, out, se)
                if not len(c[0]):
                    yield near
                    continue
                best: dict[int, float] = {}
                for i, s in (*zip(*near), *zip(*self.chosen.closest(*c, out, sc))):
                    best[int(i)] = max(best.get(int(i), 0.0), float(s))
                found = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[: self.conf.k]
                yield np.array([i for i, _ in found], np.int64), np.array([s for _, s in found], float)

    def votes(self, every: list[tuple], chosen: list[tuple], without: list[int]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        for at, s in self.nearest(every, chosen, without):
            s2 = s * s
            yield (float((s2 * self.labels[at]).sum() / (s2.sum() + 0.05)) if len(at) else 0.0), at, s

    def calibrate(self) -> Examples:
        """A logistic curve of votes to labels on the examples, each without itself; ridge keeps it finite."""
        rows = range(len(self.labels))
        x = np.array([v[0] for v in self.votes([self.every.row(i) for i in rows], [self.chosen.row(i) for i in rows], list(rows))])
        a, b = 6.0, -3.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([((p - self.labels) * x).sum() + 1e-2 * a, (p - self.labels).sum() + 1e-2 * b])
            h = p * (1 - p)
            m = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-2]])
            a, b = np.array([a, b]) - np.clip(np.linalg.solve(m, g), -2, 2)
        self.slope, self.shift = max(float(a), 0.0), float(b)
        return self

    def score(self, text: str) -> tuple[float, np.ndarray, np.ndarray]:
        """The calibrated score, the nearest examples and their similarities."""
        return next(self.scores([text]))

    def scores(self, texts: list[str]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        for a in range(0, len(texts), BATCH):
            terms = list(self.numbers.counts(texts[a : a + BATCH]))
            every, chosen = [self.every.weigh(t) for t in terms], [self.chosen.weigh(_only(self.also, t)) for t in terms]
            for vote, at, s in self.votes(every, chosen, [-1] * len(terms)):
                yield float(1 / (1 + np.exp(-(self.slope * vote + self.shift)))), at, s


def fit(labelled: DataFrame, docs: DataFrame, text: str = "text", label: str = "label", conf: Nearest = Nearest(), key: str | None = None) -> Examples | None:
    """Indexes over the distinct texts of ``labelled``, in each class those of the smallest hashes, or None when a class has no
    rows. Where copies differ in their label, the highest counts. Rows with a null label teach nothing. An example is named
    by the least ``key`` (a long) of its copies, or by nothing if no column is given."""
    name = F.min(F.col(key).cast("long") if key else F.lit(None).cast("long")).alias("key")
    rows = labelled.where(F.col(label).isin(0, 1)).groupBy(F.coalesce(F.col(text), F.lit("")).alias("x")).agg(F.max(F.col(label).cast("int")).alias("y"), name)
    rows = saved(rows)
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        drop(rows)
        return None
    llr = _llr(F.col("k").cast("double"), F.lit(float(sizes[0])), F.col("kt").cast("double"), F.lit(float(sizes[1])))
    chosen = [r["t"] for r in _class_counts(rows).select("t", "k", "kt", llr.alias("s")).where((F.col("s") >= conf.min_llr) & (F.col("kt") >= conf.min_share * (F.col("k") + F.col("kt")))).orderBy(F.desc("s"), "t").limit(conf.terms).collect()]
    parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64("x"), "x").limit(conf.examples) for y in (0, 1)]
    sample = saved(parts[0].union(parts[1]))
    drop(rows)
    every = sorted(set(chosen) | {r["t"] for r in _class_counts(sample).select("t").toLocalIterator()})
    df, total = document_frequencies(docs, every, text), docs.count()
    idf = dict(zip(every, (np.log((1 + total) / (1 + df)) + 1).tolist()))
    del every
    place = {t: i for i, t in enumerate(idf)}
    found = _numbered(sample, place)
    drop(sample)
    labels, keys = found["y"].to_numpy(), [None if k is None else int(k) for k in found["key"]]
    known = [(np.frombuffer(i, np.int32), np.frombuffer(n, np.int32)) for i, n in zip(found["ids"], found["counts"])]
    del found
    some = {t: idf[t] for t in chosen}
    also = _numbers(place, {t: i for i, t in enumerate(some)})
    del place
    second = Index(conf, some, [_only(also, x) for x in known], labels)
    first = Index(conf, idf, known, labels)
    del known, idf
    return Examples(conf, first, second, keys).calibrate()


def _numbered(sample: DataFrame, place: dict[str, int]) -> pd.DataFrame:
    """(y, key, ids, counts) of each example in a fixed order: its terms' numbers and counts as packed integers, so that no
    text comes to the driver."""
    shared = sample.sparkSession.sparkContext.broadcast(Numbers(place))

    def number(batches):
        for batch in batches:
            packed = [[a.tobytes() for a in known] for known in shared.value.counts(batch["x"])]
            yield pd.DataFrame({"y": batch["y"], "h": batch["h"], "m": batch["m"], "key": batch["key"],
                                "ids": [p[0] for p in packed], "counts": [p[1] for p in packed]})

    rows = sample.select("x", "y", F.xxhash64("x").alias("h"), F.md5("x").alias("m"), F.col("key").cast("string").alias("key"))
    out = rows.mapInPandas(number, "y int, h long, m string, key string, ids binary, counts binary").toPandas()
    shared.destroy()
    return out.sort_values(["y", "h", "m"], ignore_index=True)


def scored(docs: DataFrame, index: Examples | None, text: str = "text") -> DataFrame:
    """``docs`` with score, predicted and the evidence: ``near``, the names of the nearest examples, the nearest first, with
    their labels in ``near_labels`` and their similarities in ``near_cosines``.

    Null and empty texts are scored like texts without any known term, and have no evidence; without an index all scores
    are 0.5. Columns of these names are replaced; all others pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # at most 2 * examples texts
    limit = index.conf.threshold if index else 1.0

    @F.pandas_udf("score double, near array<long>, near_labels array<int>, near_cosines array<double>")
    def score(texts: pd.Series) -> pd.DataFrame:
        ix = shared.value
        if ix is None:
            out = [(0.5, [], [], [])] * len(texts)
        else:
            found = ix.scores([t if isinstance(t, str) else "" for t in texts])
            out = [(x, [ix.keys[i] for i in at.tolist()], ix.labels[at].astype(int).tolist(), s.tolist()) for x, at, s in found]
        return pd.DataFrame(out, columns=["score", "near", "near_labels", "near_cosines"])

    (scores,) = unused(docs, "_scored")
    found = docs.withColumn(scores, score(text))
    names = ("score", "near", "near_labels", "near_cosines")
    return found.withColumns({c: F.col(scores)[c] for c in names}).drop(scores).withColumn("predicted", (F.col("score") >= F.lit(limit)).cast("int"))


def toxicity_table(docs: DataFrame, labels: DataFrame, conf: Nearest = Nearest()) -> DataFrame:
    """(doc_id, held_out, score, predicted, near, near_labels, near_cosines) of every row, learned from a bounded sample of
    labelled rows that are not held out.

    Where a document has several labels, the highest counts. ``near`` are the doc_ids of the nearest examples.
    """
    out = held_out(F.col("doc_id"), 3, 1)
    marks = labels.where(F.col("toxic").isin(0, 1) & ~out).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("label"))
    sizes = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows at most
    rate = F.when(F.col("label") == 1, conf.labelled / sizes.get(1, 1)).otherwise(conf.labelled / sizes.get(0, 1))
    some = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) / F.lit(float(1 << 20)) < rate)
    # about 2 * labelled ids at most, so they go to the texts and no text is shuffled
    learned = saved(docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label"))
    index = fit(learned, docs, conf=conf, key="doc_id")
    drop(learned)
    return scored(docs.select("doc_id", out.alias("held_out"), "text"), index).drop("text")

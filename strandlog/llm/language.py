"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter's maximum over the window is
pooled, and a softmax over the pooled values gives the window's language. Whole texts are cut into windows; a text's
logits are the mean over its windows. Training uses a bounded sample of labelled rows; scoring needs no shuffle and
holds one batch of windows at a time, however long a text is.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.scratch import unused
from strandlog.llm.words import LOWER, blocks, mixed


@dataclass(frozen=True)
class ByteCnn:
    """per_class: distinct labelled texts of a class that training uses at most. sample_chars: about how much of such a
    row's text, in windows from all over it.
    window: bytes of a window. batch: windows scored at once."""

    per_class: int = 500
    sample_chars: int = 2000
    window: int = 128
    embed: int = 6
    filters: int = 12
    widths: tuple[int, ...] = (2, 3, 4)
    epochs: int = 6
    rate: float = 0.01
    batch: int = 512
    seed: int = 7


def windows(data: np.ndarray, size: int) -> np.ndarray:
    """The bytes of a text in rows of ``size``; the last is filled with zeros."""
    n = max(1, -(-len(data) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, size)


def some_windows(text: str, conf: ByteCnn) -> np.ndarray:
    """Windows of the whole text: those of the smallest hashes of their places, as many as ``sample_chars`` fill."""
    data = text.encode()
    out, most = windows(LOWER[np.frombuffer(data, np.uint8)], conf.window), -(-conf.sample_chars // conf.window)
    if len(out) <= most:
        return out
    return out[np.sort(np.argsort(mixed(np.arange(len(out), dtype=np.uint64) + np.uint64(zlib.crc32(data) << 20)))[:most])]


class Network:
    """Parameters and passes. All arrays are float32."""

    def __init__(self, conf: ByteCnn, classes: list[str]):
        rng = np.random.default_rng(conf.seed)
        normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.conf, self.classes = conf, classes
        self.p = {"e": rng.standard_normal((256, conf.embed)).astype(np.float32) * 0.5}
        for w in conf.widths:
            self.p[f"f{w}"], self.p[f"b{w}"] = normal(w * conf.embed, conf.filters), np.zeros(conf.filters, np.float32)
        self.p["o"], self.p["c"] = normal(conf.filters * len(conf.widths), len(classes)), np.zeros(len(classes), np.float32)

    def logits(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        e = self.p["e"][x]
        pooled = []
        for w in self.conf.widths:
            flat = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, w * self.conf.embed)
            act = flat @ self.p[f"f{w}"] + self.p[f"b{w}"]
            pooled.append(np.maximum(act.max(1), 0))
            if keep is not None:
                keep.append((w, flat, act.argmax(1)))
        h = np.concatenate(pooled, 1)
        if keep is not None:
            keep.append(h)
        return h @ self.p["o"] + self.p["c"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: list = []
        z = self.logits(x, kept)
        h = kept.pop()
        d = np.exp(z - z.max(1, keepdims=True))
        d /= d.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"o": h.T @ d, "c": d.sum(0), "e": np.zeros_like(self.p["e"])}
        dh = (d @ self.p["o"].T) * (h > 0)
        rows = np.arange(len(x))[:, None]
        n, m = self.conf.filters, self.conf.embed
        for k, (w, flat, at) in enumerate(kept):
            part = dh[:, k * n : (k + 1) * n]
            best = flat[rows, at]  # windows, filters, w * embed
            g[f"f{w}"], g[f"b{w}"] = np.einsum("bfi,bf->if", best, part), part.sum(0)
            back = part[:, :, None] * self.p[f"f{w}"].T[None]
            for j in range(w):
                np.add.at(g["e"], x[rows, at + j], back[:, :, j * m : (j + 1) * m])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Adam over shuffled batches, each class weighing the same by repeating its windows."""
        rng = np.random.default_rng(self.conf.seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t, size = 0, 128
        per = min(8000, int(np.bincount(y).max()))
        for _ in range(self.conf.epochs):
            order = rng.permutation(np.concatenate([rng.choice(np.flatnonzero(y == c), per) for c in range(len(self.classes))]))
            for i in range(0, len(order), size):
                t += 1
                for k, g in self.gradients(x[order[i : i + size]], y[order[i : i + size]]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= (self.conf.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """One row of class probabilities per text."""
        size, out = self.conf.window, []
        for _, _, data, offsets in blocks(texts):
            parts = [windows(LOWER[data[a:b]], size) for a, b in zip(offsets, offsets[1:])]
            counts = np.array([len(p) for p in parts])
            x = np.concatenate(parts)
            z = np.concatenate([self.logits(x[i : i + self.conf.batch]) for i in range(0, len(x), self.conf.batch)])
            mean = np.add.reduceat(z.astype(np.float64), np.concatenate(([0], np.cumsum(counts)[:-1]))) / counts[:, None]
            mean = np.exp(mean - mean.max(1, keepdims=True))
            out.append(mean / mean.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.classes)))


def train(rows: DataFrame, text: str = "text", label: str = "lang", conf: ByteCnn = ByteCnn()) -> Network | None:
    """A network over all labels of ``rows``, or None without labelled rows. The sample is the ``per_class`` distinct texts of
    the smallest hashes in each class; to find them only hashes are shuffled, and of the texts only those, once a task."""
    known = rows.where(F.col(label).isNotNull() & F.col(text).rlike("\\p{L}")).select(F.col(label).alias("y"), F.col(text).alias("x"))
    h = F.xxhash64("x")
    place = F.row_number().over(Window.partitionBy("y").orderBy("h"))
    least = known.select("y", h.alias("h")).distinct().withColumn("n", place).where(F.col("n") <= conf.per_class)
    least = least.select(F.col("y").alias("_y"), F.col("h").alias("_h"))

    @F.pandas_udf("binary")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: some_windows(t, conf).tobytes())

    # copies fall within their task first, so a hot text is cut once a task
    picked = known.withColumn("h", h).join(F.broadcast(least), (F.col("y") == F.col("_y")) & (F.col("h") == F.col("_h")), "left_semi")
    got = picked.groupBy("y", "h").agg(F.min("x").alias("x")).select("y", cut("x").alias("x")).toPandas()
    if not len(got):
        return None
    got = got.sort_values(["y", "x"])
    classes = sorted(set(got["y"]))
    xs, ys = [], []
    for y, x in zip(got["y"], got["x"]):
        part = np.frombuffer(x, np.uint8).reshape(-1, conf.window)
        xs.append(part)
        ys += [classes.index(y)] * len(part)
    return Network(conf, classes).fit(np.concatenate(xs), np.array(ys))


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score. ``und`` with score 0 for texts that are null or have no letter (or without a network).
    Columns of these two names are replaced; all others pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some thousand floats

    @F.pandas_udf("struct<p:string,s:double>")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        names, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
        some = np.flatnonzero(texts.notna().to_numpy())
        if model is not None and len(some):
            probs = model.probabilities(pa.array(texts.iloc[some], pa.large_string()))
            names[some] = np.array(model.classes, object)[probs.argmax(1)]
            scores[some] = probs.max(1)
        return pd.DataFrame({"p": names, "s": scores})

    lettered = F.when(F.col(text).rlike("\\p{L}"), F.col(text))
    (both,) = unused(docs, "_lang")
    got = docs.withColumn(both, predicted(lettered))
    return got.withColumns({"lang_pred": F.col(both)["p"], "score": F.col(both)["s"]}).drop(both)


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of a key's text has remainder ``fold``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def language_table(docs: DataFrame, conf: ByteCnn = ByteCnn()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the rows that are not held out."""
    out = held_out(F.col("doc_id"), 4, 2)
    net = train(docs.where(~out), conf=conf)
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), net).select("doc_id", "held_out", "lang_pred", "score")

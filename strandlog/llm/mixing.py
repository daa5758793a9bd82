"""Sampling a corpus to target weights of sources, languages and topics, by iterative proportional fitting.

Tokens are summed per (source, language, topic) cell; the cells' weights are raked to each marginal in turn; a document
has the probability of its cell, relative to the largest, which makes the expected token shares those of the raked table; a
sample takes the same factors at the scale of a token budget. DataFrame functions only. Documents are read twice; between, only cells are shuffled, already combined per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.scratch import saved, unused

WORD = "[^ \\t\\n\\x0B\\f\\r]++"
MARGINS = ("m_source", "m_lang", "m_topic")


@dataclass(frozen=True)
class Mix:
    """power: a marginal's target share is its natural one to this power, normalised. rounds: rakes of each marginal. budget: expected tokens of a
    sample, as a share of all tokens, less what cells lack that are kept whole."""

    power: float = 0.9
    rounds: int = 6
    budget: float = 0.6


def topic(text: Column) -> Column:
    """A coarse topic by markers: legal, code, contact, figures or prose; the first that holds."""
    low = F.lower(text)
    return (F.when(low.contains("license") | low.contains("copyright"), "legal").when(text.rlike("[{};]"), "code")
            .when(text.contains("@"), "contact").when(text.rlike("[0-9]"), "figures").otherwise("prose"))


def _rake(cells: DataFrame, mix: Mix) -> DataFrame:
    for m in MARGINS:
        target = F.pow(F.sum("tokens").over(Window.partitionBy(m)), F.lit(mix.power))
        cells = cells.withColumn("t" + m, target)
    cells = cells.withColumn("w", F.col("tokens").cast("double"))
    for _ in range(mix.rounds):
        for m in MARGINS:
            cells = cells.withColumn("w", F.col("w") * F.col("t" + m) / F.sum("w").over(Window.partitionBy(m)))
    return cells.withColumn("factor", F.col("w") / F.col("tokens"))


def unit(key: Column) -> Column:
    """A number in [0, 1) from the MD5 of a key's text; a null key counts as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", mix: Mix = Mix()) -> DataFrame:
    """``docs`` with a struct column ``mixture``: tokens, topic, probability, kept, rate and sampled.

    probability and kept sample down only, so that the cell of the largest factor, however small, sets the rate of all.
    rate and sampled are of a sample of the token budget, whose scale no single cell sets: cells that would need more than
    they hold are kept whole, and the others keep their raked shares among each other.

    tokens: words plus one, so that empty texts weigh something. A null text counts as empty; null sources and
    languages are classes of their own. Rows with the same key fare alike in the same cell. One column named
    ``mixture`` is an error; all others pass through.
    """
    if "mixture" in docs.columns:
        raise ValueError("the table has a column named mixture already")
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumn("mixture", F.struct(
        (F.regexp_count(whole, F.lit(WORD)) + 1).cast("long").alias("tokens"), F.coalesce(F.col(source).cast("string"), F.lit("\0")).alias("m_source"),
        F.coalesce(F.col(lang).cast("string"), F.lit("\0")).alias("m_lang"), topic(whole).alias("m_topic")))
    x = F.col("mixture")
    cells = saved(counted.groupBy(*[x[m].alias(m) for m in MARGINS]).agg(F.sum(x["tokens"]).alias("tokens")))
    raked = saved(_rake(cells, mix).select(*MARGINS, "tokens", "factor"))
    top = raked.agg(F.max("factor").alias("top"), (F.lit(mix.budget) * F.sum("tokens") / F.sum(F.col("tokens") * F.col("factor"))).alias("scale"))  # one row
    names = dict(zip((*MARGINS, "p", "r"), unused(docs, *("_" + m for m in MARGINS), "_p", "_r")))
    rates = saved(raked.join(F.broadcast(top), F.lit(True), "left").select(
        *[F.col(m).alias(names[m]) for m in MARGINS], F.round(F.col("factor") / F.col("top"), 6).alias(names["p"]), F.least(F.lit(1.0), F.round(F.col("factor") * F.col("scale"), 6)).alias(names["r"])))
    on = [x[m] == F.col(names[m]) for m in MARGINS]
    return counted.join(rates, on).withColumn("mixture", F.struct(
        x["tokens"], x["m_topic"].alias("topic"), F.col(names["p"]).alias("probability"), (unit(F.col(key)) < F.col(names["p"])).alias("kept"),
        F.col(names["r"]).alias("rate"), (unit(F.col(key)) < F.col(names["r"])).alias("sampled"))
    ).select(*docs.columns, "mixture")


def mix_table(docs: DataFrame, key: str = "doc_id", mix: Mix = Mix(), **names) -> DataFrame:
    """(key, tokens, topic, probability, kept) of every row."""
    x = F.col("mixture")
    return mixed(docs, key, mix=mix, **names).select(key, *[x[c].alias(c) for c in ("tokens", "topic", "probability", "kept")])


def sample(docs: DataFrame, key: str = "doc_id", mix: Mix = Mix(), **names) -> DataFrame:
    """The rows of a sample of the mix's token budget, with their columns."""
    return mixed(docs, key, mix=mix, **names).where(F.col("mixture")["sampled"]).select(*docs.columns)


def oracle(mix: Mix = Mix()) -> str:
    """The same in SQL, with the rakes unrolled."""
    word = "[^\\x20\\x09-\\x0D]+"
    parts = [f"""d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{word}')) + 1 AS tokens, coalesce(source, chr(0)) AS m_source,
  coalesce(lang, chr(0)) AS m_lang, CASE WHEN contains(lower(coalesce(text, '')), 'license') OR contains(lower(coalesce(text, '')), 'copyright') THEN 'legal'
  WHEN regexp_matches(coalesce(text, ''), '[{{}};]') THEN 'code' WHEN contains(coalesce(text, ''), '@') THEN 'contact'
  WHEN regexp_matches(coalesce(text, ''), '[0-9]') THEN 'figures' ELSE 'prose' END AS m_topic FROM documents)""",
             "c AS (SELECT m_source, m_lang, m_topic, sum(tokens) AS tokens FROM d GROUP BY ALL)",
             "w0 AS (SELECT *, tokens::DOUBLE AS w, " + ", ".join(
                 f"pow((sum(tokens) OVER (PARTITION BY {m}))::DOUBLE, {mix.power}) AS t{m}" for m in MARGINS) + " FROM c)"]
    n = 0
    for _ in range(mix.rounds):
        for m in MARGINS:
            parts.append(f"w{n + 1} AS (SELECT * REPLACE (w * t{m} / sum(w) OVER (PARTITION BY {m}) AS w) FROM w{n})")
            n += 1
    parts.append(f"r AS (SELECT m_source, m_lang, m_topic, round((w / tokens) / max(w / tokens) OVER (), 6) AS p FROM w{n})")
    return ("WITH " + ",\n".join(parts) + "\nSELECT doc_id, CAST(d.tokens AS BIGINT) AS tokens, m_topic AS topic, p AS probability, "
            "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < p AS kept FROM d JOIN r USING (m_source, m_lang, m_topic)")

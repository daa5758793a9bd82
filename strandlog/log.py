"""The mutation log: one row per Put or Delete, totally ordered by ``seq``.

Schema ``(seq BIGINT, op INT, key STRING|BINARY, value STRING|BINARY)``. ``op`` 0 is a put, 1 a delete;
``value`` is NULL exactly for deletes, so an empty value stays a live value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PUT, DEL = 0, 1
COLUMNS = ("seq", "op", "key", "value")


def events_log(events: DataFrame) -> DataFrame:
    """The canonical log of an event stream: errors delete the user's key, all other events upsert it."""
    is_del = F.col("event_type") == "error"
    return events.select(
        (F.col("event_id") + 1).cast("long").alias("seq"),
        F.when(is_del, DEL).otherwise(PUT).cast("int").alias("op"),
        F.format_string("user%06d", F.col("user_id")).alias("key"),
        F.when(~is_del, F.concat("event_type", F.lit("|"), "props")).alias("value"),
    )


def load_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def with_run(log: DataFrame, size: int = 250) -> DataFrame:
    """Run number of each row when a run is cut every ``size`` mutations."""
    return log.withColumn("run", F.floor((F.col("seq") - 1) / F.lit(size)).cast("long"))


def puts(df: DataFrame) -> DataFrame:
    """(key, value) rows as put mutations. A NULL value is an error: NULL is reserved for tombstones."""
    return df.withColumns({
        "op": F.lit(PUT),
        "value": F.when(F.col("value").isNotNull(), F.col("value")).otherwise(
            F.raise_error(F.lit("put of a NULL value: NULL is reserved for deletes"))),
    })


def deletes(df: DataFrame) -> DataFrame:
    """Keys as blind tombstones; a key need not exist."""
    return df.withColumns({"op": F.lit(DEL), "value": F.lit(None).cast("string")})


def validated(log: DataFrame) -> DataFrame:
    """Fails at run time on NULL keys, unknown ops, puts without a value and deletes with one."""
    bad = (
        F.col("key").isNull() | F.col("op").isNull() | ~F.col("op").isin(PUT, DEL)
        | ((F.col("op") == PUT) & F.col("value").isNull()) | ((F.col("op") == DEL) & F.col("value").isNotNull())
    )
    return log.withColumn("key", F.when(bad, F.raise_error(F.lit("invalid mutation"))).otherwise(F.col("key")))


def numbered(df: DataFrame, order_by: str, after: int = 0) -> DataFrame:
    """Dense ``seq`` in ``order_by`` order, starting at ``after + 1``, without funnelling rows into one task.

    Rows are range-partitioned, numbered inside each of many range cells, and offset by the running count of the
    cells before. Only the cell counts (one row for each of at most 1024 cells) pass through one task.
    """
    cells = 1024
    place = F.col(order_by)
    if df.schema[order_by].dataType.simpleString() in ("string", "binary"):
        # the six bytes after what all values share, as a number: same order, with ties
        raw = place.cast("binary")
        ends = df.agg(F.min(raw).alias("lo"), F.max(raw).alias("hi")).first()
        lo, hi = bytes(ends["lo"] or b""), bytes(ends["hi"] or b"")
        shared = next((i for i, (x, y) in enumerate(zip(lo, hi, strict=False)) if x != y), min(len(lo), len(hi)))
        place = F.conv(F.rpad(F.hex(F.substring(raw, shared + 1, 6)), 12, "0"), 16, 10).cast("double")
    bounds = df.select(F.percentile_approx(place, [i / cells for i in range(1, cells)], 100000).alias("b"))
    placed = df.crossJoin(F.broadcast(bounds)).withColumn(
        "_cell", F.size(F.filter(F.coalesce("b", F.array()), lambda x: x < place))).drop("b")
    counts = placed.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy(order_by))
    return (placed.join(F.broadcast(offsets), "_cell")
            .withColumn("seq", (inside + F.col("_before") + F.lit(after)).cast("long")).drop("_cell", "_before"))

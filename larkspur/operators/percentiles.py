"""Exact percentiles by narrowing: no task holds more than the distinct values of a small slice of a group.

Each of two passes cuts the slice that holds a rank, first the whole range of a group, into ``CELLS`` cells of equal
width, counts their values and keeps the cell in which the rank falls. Values of the last cells are counted one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 4096


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _cell(value: str, low: str, high: str) -> Column:
    share = F.try_divide(F.col(value) - F.col(low), F.col(high) - F.col(low))
    return F.when(share.isNull() | F.isnan(share), F.lit(0)).otherwise(F.least(F.lit(CELLS - 1), F.floor(share * CELLS).cast("int")))


def _before(counted: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``counted`` with the number of values before each row, within its keys."""
    rows = Window.partitionBy(*map(_q, keys)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("_before", F.coalesce(F.sum("_n").over(rows), F.lit(0).cast("long")))


def percentiles(df: DataFrame, keys: list[str], value: Column, shares: list[float], name: str) -> DataFrame:
    """``keys`` and ``name``: the values at ``shares`` of each group, linear between neighbours; groups without values are left out."""
    rows = df.select(*map(_q, keys), F.lit(1).alias("_one"), value.cast("double").alias("_v")).where("_v is not null")
    keys = [*keys, "_one"]
    whole = rows.groupBy(*map(_q, keys)).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_all"))
    # a rank below and one above for each share
    spots = [F.struct(F.lit(i).alias("share"), F.lit(side).alias("side"), F.when(F.lit(side == 0), F.floor(F.lit(p) * (F.col("_all") - 1))).otherwise(F.ceil(F.lit(p) * (F.col("_all") - 1))).cast("long").alias("rank")) for i, p in enumerate(shares) for side in (0, 1)]
    wanted = whole.select(*map(_q, keys), F.explode(F.array(*spots)).alias("_spot")).select(*map(_q, keys), "_spot.share", "_spot.side", "_spot.rank")
    at = list(keys)
    inside = rows.join(whole.drop("_all"), keys)
    for level in (1, 2):
        cell = f"_cell{level}"
        inside = inside.withColumn(cell, _cell("_v", "_low", "_high")).drop("_low", "_high")
        counted = inside.groupBy(*map(_q, [*at, cell])).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        found = wanted.join(_before(counted, at, cell), at).where("rank >= _before and rank < _before + _n")
        wanted = found.select(*map(_q, [*at, cell]), "share", "side", (F.col("rank") - F.col("_before")).alias("rank"))
        at = [*at, cell]
        inside = inside.join(found.select(*map(_q, at), "_low", "_high").distinct(), at)
    values = _before(inside.groupBy(*map(_q, at), "_v").agg(F.count("*").alias("_n")), at, "_v")
    picked = wanted.join(values, at).where("rank >= _before and rank < _before + _n")
    ends = picked.groupBy(*map(_q, keys), "share").agg(F.max(F.when(F.col("side") == 0, F.col("_v"))).alias("_a"), F.max(F.when(F.col("side") == 1, F.col("_v"))).alias("_b"))
    p = F.get(F.array(*[F.lit(float(s)) for s in shares]), F.col("share"))
    spot = p * (F.col("_all") - 1)
    ends = ends.join(whole.select(*map(_q, keys), "_all"), keys).withColumn("_p", F.col("_a") + (F.col("_b") - F.col("_a")) * (spot - F.floor(spot)))
    return ends.groupBy(*map(_q, keys)).agg(F.transform(F.array_sort(F.collect_list(F.struct("share", "_p"))), lambda x: x["_p"]).alias(name)).drop("_one")

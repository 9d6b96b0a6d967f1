"""Places in an order, and values at places, without one task that sees every row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.session import settle

#: Cells that a pass divides each range of values into; values of all ranges that the driver takes at last.
CELLS, LAST = 1024, 4096


def numbered(rows: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """rows with their place (from 0) in that order, which should tell them apart.

    Rows are dealt by ranges of the order; row_number counts within a range, and the rows of the ranges before it are added.
    """
    placed = settle(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = placed.groupBy(F.col("__range").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.orderBy("__of")) - F.col("__n")  # a row a range
    within = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    starts = counts.select("__of", before.alias("__start"))
    return placed.join(F.broadcast(starts), F.col("__range") == F.col("__of")).withColumn(name, F.col("__start") + within - 1).drop("__range", "__of", "__start")


def at_ranks(values: DataFrame, ranks: list[int], n: int) -> dict[int, float]:
    """The values at these places (from 0) of the column v (double, no nulls) of ``values``, n rows.

    Passes count the values by cells of a range and go on with the cells that hold a wanted place, until a range is one
    value, or few are left. A cell's ends are its least and greatest value, so each pass makes it smaller; the driver gets at most
    CELLS rows for each range and LAST values.
    """
    first = values.agg(F.min("v"), F.max("v")).first()
    found: dict[int, float] = {}
    open_ = [(float(first[0]), float(first[1]), 0, n, sorted(set(ranks)))] if n else []  # least, greatest, place of the least, rows, places wanted
    while open_:
        for lo, hi, _, _, own in open_:
            if lo == hi:
                found |= dict.fromkeys(own, lo)
        open_ = [r for r in open_ if r[0] < r[1]]
        if not open_:
            break
        if sum(r[3] for r in open_) <= LAST:
            within = values.filter(_any([F.col("v").between(lo, hi) for lo, hi, *_ in open_]))
            got = sorted(r["v"] for r in within.select("v").collect())
            at = 0
            for _, _, start, rows, own in sorted(open_):
                found |= {k: got[at + k - start] for k in own}
                at += rows
            break
        range_, cell = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (lo, hi, *_) in enumerate(open_):
            inside = F.col("v").between(lo, hi)
            share = (F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2)  # halves, so that the widest range stays finite
            range_, cell = F.when(inside, i).otherwise(range_), F.when(inside, F.floor(share * CELLS).cast("int")).otherwise(cell)
        cells = values.select("v", range_.alias("r"), cell.alias("c")).filter("r is not null").groupBy("r", "c").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        by: dict[int, list] = {}
        for r in sorted(cells.collect(), key=lambda r: (r["r"], r["c"])):
            by.setdefault(r["r"], []).append(r)
        after = []
        for i, (_, _, start, _, own) in enumerate(open_):
            for r in by[i]:
                wanted = [k for k in own if start <= k < start + r["n"]]
                if wanted:
                    after.append((r["lo"], r["hi"], start, r["n"], wanted))
                start += r["n"]
        open_ = after
    return found


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out |= c
    return out


def quantiles(rows: DataFrame, value: Column | str, shares: list[float]) -> list[float | None]:
    """The values at these shares of the ordered rows, between two rows in proportion; null values and NaN count for nothing, None without any.

    Exact: no sketch, and no task that gets all distinct values.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    values = settle(rows.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")), "values")
    n = values.count()
    if not n:
        return [None] * len(shares)
    places = [q * (n - 1) for q in shares]
    got = at_ranks(values, [k for p in places for k in (math.floor(p), math.ceil(p))], n)
    return [got[math.floor(p)] + (got[math.ceil(p)] - got[math.floor(p)]) * (p - math.floor(p)) for p in places]

"""The next row in a global order, without a global window.

Rows are dealt into ranges of the order by approximate percentiles, a window
runs inside each range, and the last row of a range takes the first row of
the next non-empty one from a table with one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending keys that cut ``df`` into about equal ranges."""
    if n < 2:
        return []
    cuts = [F.lit(i / n) for i in range(1, n)]
    found = df.select(F.percentile_approx(F.col(key), F.array(*cuts), F.lit(max(10_000, 20 * n))).alias("b")).first()["b"]
    return sorted(set(found or []))


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below ``key``; null goes to the last range."""
    if not bounds:
        return F.lit(0)
    at = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= key))
    return F.when(key.isNull(), F.lit(len(bounds))).otherwise(at)


def with_next(df: DataFrame, key: str, tie: str, value: Column, out: str, parts: int, before=None) -> DataFrame:
    """Add ``out``: ``value`` of the next row by (key ascending, null last; tie); the last row takes the first row's.

    ``before``: applied to the rows once they are dealt, before they are ordered.
    """
    bounds = range_bounds(df, key, parts)
    part, head = fresh("_part", df.columns), fresh("_head", df.columns)
    dealt = df.withColumn(part, range_of(F.col(key), bounds)).repartition(part)
    dealt = before(dealt) if before else dealt
    order = [F.col(key).asc_nulls_last(), F.col(tie).asc_nulls_first()]
    w = W.partitionBy(part).orderBy(*order)
    rows = dealt.withColumn(out, F.lead(value).over(w)).withColumn(head, F.row_number().over(w))
    last = fresh("_last", df.columns)
    rows = rows.withColumn(last, F.lead(F.lit(True)).over(w).isNull())
    # one row per range: its first value
    first_rows = _first_rows(df, key, tie, bounds, part, value, before)
    ring = W.orderBy(part)
    heads = first_rows.withColumn("_following", F.coalesce(F.lead("_value").over(ring), F.first("_value").over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    heads = heads.select(F.col(part).alias(head + "p"), F.col("_following"))
    joined = rows.join(F.broadcast(heads), (F.col(part) == F.col(head + "p")) & F.col(last), "left")
    return joined.withColumn(out, F.when(F.col(last), F.col("_following")).otherwise(F.col(out))).drop(part, head, last, head + "p", "_following")


def _first_rows(df: DataFrame, key: str, tie: str, bounds: list[int], part: str, value: Column, before) -> DataFrame:
    """(part, _value) of the first row of every range that has rows: at most as many rows as ranges."""
    keyed = df.withColumn(part, range_of(F.col(key), bounds))
    least = keyed.groupBy(part).agg(F.min(key).alias("_least"))
    heads = keyed.join(F.broadcast(least.withColumnRenamed(part, "_p")), (F.col(part) == F.col("_p")) & F.col(key).eqNullSafe(F.col("_least")))
    heads = heads.drop("_p", "_least")
    heads = before(heads) if before else heads
    pick = heads.select(part, F.col(tie).alias("_tie"), value.alias("_value"))
    one = W.partitionBy(part).orderBy(F.col("_tie").asc_nulls_first())
    return pick.withColumn("_n", F.row_number().over(one)).where("_n = 1").select(part, "_value")

"""Operators on ordered rows: islands, carried values, gaps, ranges, medians of neighbours, robust lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """(keys, first, last) of each run of consecutive whole numbers; repeats count once."""
    w = Window.partitionBy(*keys).orderBy(number)
    run = rows.select(*keys, number).distinct().withColumn("_run", F.col(number) - F.row_number().over(w))
    return run.groupBy(*keys, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_run")


def range_list(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ranges) with ranges as `1-3, 7`."""
    one = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    named = F.transform(F.array_sort(F.collect_list(F.struct("first", one.alias("s")))), lambda x: x["s"])
    return runs.groupBy(*keys).agg(F.array_join(named, ", ").alias("ranges"))


def carried(value: Column, keys: Sequence[str], order: Sequence[Column | str]) -> Column:
    """The last value so far that isn't null."""
    return F.last_value(value, ignoreNulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def gap_filled(number: Column, keys: Sequence[str], order: Sequence[Column | str]) -> Column:
    """Missing numbers between two known ones, counted up from the one before, if as many fit as are missing; else null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    row = F.row_number().over(w)
    known = F.when(number.isNotNull(), F.struct(number.alias("n"), row.alias("r")))
    low = F.last_value(known, ignoreNulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first_value(known, ignoreNulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    fits = (high["n"] - low["n"]) == (high["r"] - low["r"])
    return F.coalesce(number, F.when(fits, low["n"] + row - low["r"]))


def block_number(gap: Column, keys: Sequence[str], order: Sequence[Column | str]) -> Column:
    """Counts up at each row whose gap condition holds."""
    return F.sum(F.when(gap, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def theil_sen(points: DataFrame, keys: Sequence[str], x: str, y: str, least: float) -> DataFrame:
    """(keys, slope, intercept): median slope of the pairs of a group further apart than least in y, 25th percentile of the intercepts.

    Pairs within a group are what the estimator is made of; groups are the few dozen lines of one page.
    """
    a, b = points.select(*keys, F.col(x).alias("x1"), F.col(y).alias("y1")), points.select(*keys, F.col(x).alias("x2"), F.col(y).alias("y2"))
    pairs = a.join(b, list(keys)).where(F.col("y2") - F.col("y1") > least)
    slope = pairs.groupBy(*keys).agg(F.median((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("slope"))
    return points.join(slope, list(keys)).groupBy(*keys).agg(F.first("slope").alias("slope"), F.percentile(F.col(x) - F.col("slope") * F.col(y), F.lit(0.25)).alias("intercept"))


def overlap_assign(words: DataFrame, quads: DataFrame, page: Sequence[str], word_id: str, quad_id: str, least: float = 0.5) -> DataFrame:
    """(page, word, quad): the first quad of its page that covers at least that share of a word's box. Boxes: left, top, right, bottom; q_ for quads."""
    wide = F.least("right", "q_right") - F.greatest("left", "q_left")
    high = F.least("bottom", "q_bottom") - F.greatest("top", "q_top")
    area = (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))
    hit = words.join(quads, list(page)).where((wide > 0) & (high > 0) & (wide * high >= least * area))
    return hit.groupBy(*page, word_id).agg(F.min(quad_id).alias(quad_id))

"""Queries on labelled arrays in long form: a row a cell, with an index and a label column for each dimension.

Selections are plain predicates, so that they reach the scan; where the chunk
layout is known, ``chunks_of`` gives the chunk numbers of a label range and
``prune`` adds them as a predicate on the chunk column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from hashloom.sources import scratch

#: Rows of one range of ``nearest``, about, and its ranges at most.
RANGE_ROWS, MOST_RANGES = 50_000, 20_000

def sel(cells: DataFrame, **bounds) -> DataFrame:
    """Cells whose labels equal a value or lie in a (low, high) range, both ends included; None leaves a side open."""
    for name, want in bounds.items():
        if isinstance(want, tuple):
            low, high = want
            cells = cells if low is None else cells.where(F.col(name) >= low)
            cells = cells if high is None else cells.where(F.col(name) <= high)
        else:
            cells = cells.where(F.col(name) == want)
    return cells


def isel(cells: DataFrame, **bounds) -> DataFrame:
    """Cells by position: one, or a (first, end) range without its end. The columns hold positions."""
    for name, want in bounds.items():
        cells = cells.where((F.col(name) >= want[0]) & (F.col(name) < want[1])) if isinstance(want, tuple) else cells.where(F.col(name) == want)
    return cells


def nearest(labels: DataFrame, label: str, targets: DataFrame, target: str = "target") -> DataFrame:
    """(target, label): the nearest label of each target, the smaller one of two at the same distance.

    Labels and targets are dealt out together by ranges of their values, sampled so
    that the ranges hold about as many rows each however the values lie. Within a
    range the last label before a target and the first one behind are running
    aggregates; the ends of the ranges (``MOST_RANGES`` rows at most) are handed
    from range to range. No cross join, and no task with more than its range.
    """
    kind = labels.schema[label].dataType
    points = labels.select(F.col(label).alias("x"), F.col(label).alias("own"), F.lit(False).alias("ask")).where("x is not null").distinct()
    asks = targets.select(F.col(target).cast(kind).alias("x"), F.lit(None).cast(kind).alias("own"), F.lit(True).alias("ask")).distinct()
    both = points.unionByName(asks)
    placed = scratch.ranged(both, "x", RANGE_ROWS, MOST_RANGES)
    ends = placed.groupBy("range").agg(F.min("own").alias("first"), F.max("own").alias("last"))
    over = Window.orderBy("range")
    last, first = F.max("last").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.min("first").over(over.rowsBetween(1, Window.unboundedFollowing))
    ends = ends.select("range", last.alias("before"), first.alias("behind"))
    # Both frames begin at an end of the range, so each is one pass over it.
    up, down = Window.partitionBy("range").orderBy("x"), Window.partitionBy("range").orderBy(F.desc("x"))
    near = placed.select("x", "range", "ask", F.max("own").over(up).alias("down"), F.min("own").over(down).alias("up")).where("ask")
    near = near.join(F.broadcast(ends), "range").select("x", F.coalesce("down", "before").alias("down"), F.coalesce("up", "behind").alias("up"))
    number = lambda c: c.cast("double") if kind.typeName() not in ("timestamp", "timestamp_ntz") else F.unix_micros(c.cast("timestamp")).cast("double")
    gap = lambda c: F.abs(number(F.col(c)) - number(F.col("x")))
    below = F.col("down").isNull() | (gap("up") < gap("down"))
    return near.select(F.col("x").alias(target), F.when(below, F.col("up")).otherwise(F.col("down")).alias(label))


def nearest_one(labels: DataFrame, label: str, value) -> DataFrame:
    """The label nearest to one value; the smaller of two at the same distance."""
    return labels.agg(F.min_by(label, F.struct(F.abs(F.col(label) - F.lit(value)), F.col(label))).alias(label))


def concat(*parts: DataFrame) -> DataFrame:
    """Arrays behind one another along a dimension: lazy, by column name."""
    return reduce(DataFrame.unionByName, parts)


def stitch(final: DataFrame, provisional: DataFrame, dim: str) -> DataFrame:
    """Final cells, and provisional ones behind the last final label."""
    last = final.agg(F.max(dim)).scalar()
    return final.unionByName(provisional.where(last.isNull() | (F.col(dim) > last)))


def extent(cells: DataFrame, *dims: str) -> DataFrame:
    """Least and greatest label of each dimension."""
    return cells.agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))])


def not_increasing(labels: DataFrame, position: str, label: str) -> DataFrame:
    """Positions whose label is not greater than the one before; none for a strictly increasing sequence. A join on the position, not a window over all rows."""
    before = labels.select((F.col(position) + 1).alias(position), F.col(label).alias("before"))
    return labels.join(before, position).where(F.col(label) <= F.col("before")).select(position)


def append(cells: DataFrame, more: DataFrame, position: str) -> DataFrame:
    """Cells with more of them behind, at shifted positions."""
    size = cells.agg(F.coalesce(F.max(position), F.lit(-1)) + 1).scalar()
    return cells.unionByName(more.withColumn(position, F.col(position) + size))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells that only one of the two has, with repeats; none if they are identical."""
    columns = a.columns
    return a.exceptAll(b.select(columns)).withColumn("side", F.lit("left")).unionByName(b.select(columns).exceptAll(a).withColumn("side", F.lit("right")))


def rechunk(cells: DataFrame, **sizes: int) -> DataFrame:
    """Adds the chunk number of every named position column, as <name>_chunk."""
    return cells.select("*", *[F.floor(F.col(c) / n).cast("long").alias(f"{c}_chunk") for c, n in sizes.items()])


def chunks_of(labels: DataFrame, label: str, position: str, size: int, low, high) -> DataFrame:
    """The chunk numbers that hold labels in a range: one aggregate over the small label table."""
    return sel(labels, **{label: (low, high)}).agg(F.floor(F.min(position) / size).cast("long").alias("first"), F.floor(F.max(position) / size).cast("long").alias("last"))


def prune(cells: DataFrame, chunk: str, first: int, last: int) -> DataFrame:
    """Cells in a range of chunks: a predicate that the scan can use where the table is partitioned by chunk."""
    return cells.where(F.col(chunk).between(first, last))


def cells_by(values: DataFrame, dims: dict[str, Column], value: str, order: tuple[str, ...]) -> DataFrame:
    """One cell for each place: the last value by the given order."""
    named = values.select(*[c.alias(n) for n, c in dims.items()], F.col(value).alias("v"), F.struct(*order).alias("at"))
    return named.groupBy(*dims).agg(F.max_by("v", "at").alias(value))

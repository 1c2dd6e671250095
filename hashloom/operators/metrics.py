"""Read metrics over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hashloom.sources import scratch

#: Percentiles are taken over the first so many values of a metric.
SAMPLE_LIMIT = 2000
#: Partitions whose first values are merged in one group.
FAN = 1000


def _first(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group, in the order of ``at``."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("at"))).where(F.col("nth") <= limit).drop("nth")


def distribution(events: DataFrame, name: str, value: str, order: tuple[str, ...], limit: int = SAMPLE_LIMIT) -> DataFrame:
    """Count and mean over all values of each metric; min, median, nearest-rank p95 and p99, max over its first ``limit`` ones.

    The first values are taken of each partition, then of each ``FAN`` partitions, then
    of all, so a metric that a third of all rows share is sorted in no single task.
    """
    totals = events.groupBy(name).agg(F.count(value).alias("n"), F.sum(value).alias("total"))
    some = events.where(F.col(value).isNotNull())
    first = some.select(F.col(name).alias("name"), F.col(value).alias("value"), F.struct(*order).alias("at"), F.spark_partition_id().alias("part"))
    first = _first(first, ["name", "part"], limit).withColumn("part", F.floor(F.col("part") / FAN))
    first = _first(_first(first, ["name", "part"], limit), ["name"], limit)
    sample = first.groupBy(F.col("name").alias(name)).agg(F.sort_array(F.collect_list("value")).alias("s"))
    at = lambda p: F.element_at("s", F.bround((F.size("s") - 1) * F.lit(p)).cast("int") + 1)
    half = F.size("s") / 2
    median = (F.element_at("s", F.floor(half + 0.5).cast("int")) + F.element_at("s", F.floor(half + 1).cast("int"))) / 2
    return totals.join(sample, name, "left").select(name, "n", (F.col("total") / F.col("n")).alias("avg"), F.size("s").cast("long").alias("n_sample"), F.element_at("s", 1).alias("min"), median.alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.element_at("s", -1).alias("max"))


def most_common(events: DataFrame, key: str, k: int = 20) -> DataFrame:
    """The k most frequent values; ties go to the smaller value."""
    return events.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def repeats(events: DataFrame, key: str) -> DataFrame:
    """Requests, different values and requests beyond the first of each."""
    return events.groupBy(key).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_requests"), F.count("*").alias("n_unique"), F.sum(F.col("n") - 1).alias("n_repeated"))


def counters(events: DataFrame, by: list[str], amount: str | None = None) -> DataFrame:
    """Counts (and summed amounts) of events by any columns."""
    extra = [F.sum(amount).alias("amount")] if amount else []
    return events.groupBy(*by).agg(F.count("*").alias("n"), *extra)


def hit_miss(events: DataFrame, store: str, kind: str, hit: Column) -> DataFrame:
    """Hits and misses by store and kind, with all subtotals."""
    return events.withColumn("hit", hit).cube(store, kind).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def max_inflight(events: DataFrame, begin: str, end: str) -> DataFrame:
    """The greatest number of loads under way at once; a load that ends when another begins is over.

    Changes are summed by their time first. Ranges of times with about as many rows
    each are summed up in parallel, and the ranges' totals, one row each and of
    bounded number, are carried on from one to the next.
    """
    steps = events.select(F.col(begin).alias("t"), F.lit(1).alias("by")).unionByName(events.select(F.col(end).alias("t"), F.lit(-1).alias("by")))
    placed = scratch.ranged(steps.groupBy("t").agg(F.sum("by").alias("by")), "t")
    inner = Window.partitionBy("range").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ranges = placed.withColumn("level", F.sum("by").over(inner)).groupBy("range").agg(F.max("level").alias("top"), F.sum("by").alias("net"))
    before = F.coalesce(F.sum("net").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranges.select((before + F.col("top")).alias("level")).agg(F.max("level").alias("max_inflight"))

"""Lists, counts, joins and rankings that an archive's pages are made of.

All functions take DataFrames and give DataFrames; "today" is always a
parameter, so results can be repeated. Ties that the original leaves open are
broken by a last key that the caller names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulary.sources.stored import kept


def all_of(tests: list[Column | None]) -> Column:
    """Conjunction of the tests that are given; true without any."""
    return reduce(lambda a, b: a & b, (t for t in tests if t is not None), F.lit(True))


def date_filter(date: Column, year: int | None = None, begin: str | None = None, end: str | None = None, year_yields: bool = True) -> Column:
    """Inclusive range and year. With ``year_yields`` (search) a range overrides the year; lists apply both."""
    ranged = begin is not None or end is not None
    return all_of([
        (F.year(date) == year) if year is not None and not (ranged and year_yields) else None,
        (date >= F.lit(begin).cast("date")) if begin is not None else None,
        (date <= F.lit(end).cast("date")) if end is not None else None,
    ])


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``, their place from 0 in ``order``, which must leave no ties.

    Ranges of the order are written; each row's place is that in its range and the number of rows in
    the ranges before. So no task sees more than a range, and the numbers can be computed again.
    """
    ranges = kept(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranges.withColumn("__within", within).join(before, "__range").withColumn(name, F.col("__before") + F.col("__within")).drop("__range", "__before", "__within")


def deadline_state(deadline: Column, today: Column) -> Column:
    """open, closed, or null without a deadline."""
    return F.when(deadline >= today, "open").when(deadline < today, "closed")


def recent(date: Column, today: Column, months: int, inclusive: bool = False) -> Column:
    edge = F.add_months(today, -months)
    return date >= edge if inclusive else date > edge


def with_labels(rows: DataFrame, bridge: DataFrame, key: str, label: str, name: str) -> DataFrame:
    """``rows`` with the sorted distinct labels that ``bridge`` has for each key; an empty array without any."""
    found = bridge.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias(name))
    kind = f"array<{bridge.schema[label].dataType.simpleString()}>"
    return rows.join(found, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def with_best(rows: DataFrame, bridge: DataFrame, key: str, value: str, rank: list[str], name: str) -> DataFrame:
    """``rows`` with the value that ranks highest for each key; null without any."""
    found = bridge.groupBy(key).agg(F.max_by(value, F.struct(*rank)).alias(name))
    return rows.join(found, key, "left")


def having_any(rows: DataFrame, bridge: DataFrame, key: str, tests: list[Column]) -> DataFrame:
    """Rows that have, for each test, a bridge row passing it."""
    for test in tests:
        rows = rows.join(bridge.where(test).select(key), key, "left_semi")
    return rows


def first_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def co_occurring(bridge: DataFrame, group: str, item: str, of: Column, limit: int) -> DataFrame:
    """(item, n): items that share groups with the given one, most often first.

    Only the groups of the given item are joined, so the work follows its own
    occurrences and not the square of large groups.
    """
    mine = bridge.where(F.col(item) == of).select(group).distinct()
    others = bridge.where(F.col(item) != of).select(group, item).distinct().join(mine, group, "left_semi")
    return others.groupBy(item).agg(F.count("*").alias("n")).orderBy(F.desc("n"), item).limit(limit)


def adjacent(rows: DataFrame, keys: list[str], at: list) -> DataFrame:
    """The rows before and after the position ``at`` in the order of ``keys``; column side: prev, next."""
    here = F.struct(*(F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, at, strict=True)))
    mine = F.struct(*keys)
    prev = rows.where(mine < here).orderBy(*(F.desc(k) for k in keys)).limit(1).withColumn("side", F.lit("prev"))
    after = rows.where(mine > here).orderBy(*keys).limit(1).withColumn("side", F.lit("next"))
    return prev.unionByName(after)


def carry_down(rows: DataFrame, group: list[str], order: list[str], column: str) -> DataFrame:
    """Empty or null values take the last one above them."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(F.nullif(F.col(column), F.lit("")), ignorenulls=True).over(w))


def in_list_order(rows: DataFrame, key: str, keys: list) -> DataFrame:
    """Rows of the listed keys in the list's order; unknown keys are left out."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType
    wanted = spark.createDataFrame([(i, k) for i, k in enumerate(dict.fromkeys(keys))], f"__pos int, {key} {kind.simpleString()}")
    return rows.join(wanted, key).orderBy("__pos").drop("__pos")


def latest_before(rows: DataFrame, date: str, day: str | None = None) -> DataFrame:
    """The latest day, or the latest before ``day``; null if there is none."""
    found = rows if day is None else rows.where(F.col(date) < F.lit(day).cast("date"))
    return found.agg(F.max(date).alias("day"))


def earlier_match(later: DataFrame, earlier: DataFrame, keys: list[str], date: str, id_col: str) -> DataFrame:
    """``later`` with ``source_id``: the latest row of ``earlier`` with equal keys and an earlier date.

    A window over both sides keyed by ``keys`` finds it in one shuffle, without
    pairing a key's rows with each other.
    """
    both = later.withColumn("__late", F.lit(1)).unionByName(earlier.withColumn("__late", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(date), F.desc("__late"), id_col).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("__late") == 0, F.struct(date, id_col)), ignorenulls=True).over(w)
    return both.withColumn("source_id", seen[id_col]).where("__late = 1").select(*later.columns, "source_id")


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def ending_like(rows: DataFrame, title: str, of: str, least: int = 25) -> DataFrame:
    """Rows whose title ends in the last dash-separated part of the title ``of``; none for parts of
    ``least`` characters or fewer."""
    end = of.rsplit("-", 1)[-1].strip()
    return rows.where(F.col(title).endswith(end)) if len(end) > least else rows.limit(0)

"""Keyed merges with a policy per column, for tables without row-level updates.

The merged table is a new DataFrame; the caller writes it beside the old one and
swaps. Updates are reduced to one row per key first, on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: old: an existing row keeps its value. new: the update's. prefer_new, prefer_old: the
#: other where the preferred is null. either: true if one is.
POLICIES = ("old", "new", "prefer_new", "prefer_old", "either")


def merge(target: DataFrame, updates: DataFrame, keys: list[str], policy: dict[str, str], order: str | None = None) -> DataFrame:
    """``target`` with ``updates`` merged in by ``keys``, and __inserted.

    Columns without a policy keep the old value of existing rows. Of several
    updates of a key the one that is last by ``order`` holds; for prefer_new the
    last non-null value, for prefer_old and old the first.
    """
    others = [c for c in target.columns if c not in keys]
    rank = order or keys[0]
    one = []
    for c in others:
        how = policy.get(c, "old")
        if how not in POLICIES:
            raise ValueError(f"unknown policy {how}")
        pair = F.struct(F.col(rank).alias("r"), F.col(c).alias("v"))
        if how == "prefer_new":
            one.append(F.max(F.when(F.col(c).isNotNull(), pair))["v"].alias(c))
        elif how == "prefer_old":
            one.append(F.min(F.when(F.col(c).isNotNull(), pair))["v"].alias(c))
        elif how == "either":
            one.append(F.max(c).alias(c))
        else:
            one.append((F.max(pair) if how == "new" else F.min(pair))["v"].alias(c))
    fresh = updates.groupBy(*keys).agg(*one).withColumn("__new", F.lit(True))
    old = target.withColumn("__old", F.lit(True)).alias("o")
    joined = old.join(fresh.alias("n"), keys, "full_outer")
    picked = []
    for c in others:
        how = policy.get(c, "old")
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        kept = {"old": o, "new": F.when(F.col("__new"), n).otherwise(o), "prefer_new": F.coalesce(n, o), "prefer_old": F.coalesce(o, n), "either": F.coalesce(o, F.lit(False)) | F.coalesce(n, F.lit(False))}[how]
        picked.append(F.when(F.col("__old").isNull(), n).otherwise(kept).alias(c))
    return joined.select(*keys, *picked, F.col("__old").isNull().alias("__inserted"))


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``target`` and the first row of each new key."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return target.unionByName(first.join(target.select(*keys), keys, "left_anti"))


def changed(old: DataFrame, new: DataFrame, key: str, values: str) -> DataFrame:
    """Keys of ``new`` whose set of ``values`` (array) differs from the old one; a missing one is empty."""
    o = old.select(key, F.col(values).alias("__old"))
    empty = F.array().cast(new.schema[values].dataType)
    sets = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, empty)))
    return new.join(o, key, "left").where(sets(F.col(values)) != sets(F.col("__old"))).select(key)


def work_queue(rows: DataFrame, status: str, tries: str, updated: str, today, order: list, most: int | None = 40) -> DataFrame:
    """Pending rows, and failed or doubtful ones with under 3 tries that rested 30 days."""
    retry = F.col(status).isin("failed", "needs_review") & (F.col(tries) < 3) & (F.col(updated) < F.date_sub(today, 30))
    queue = rows.where((F.col(status) == "pending") | retry).orderBy(*order)
    return queue if most is None else queue.limit(most)


def inherit_labels(rows: DataFrame, labels: DataFrame, references: DataFrame, id_col: str, label: str) -> DataFrame:
    """(id_col, label): labels that rows without any take over from the rows they refer to; one step, no chains.

    ``references`` has (id_col, cited_id)."""
    bare = rows.select(id_col).join(labels.select(id_col), id_col, "left_anti")
    cited = references.where(F.col(id_col) != F.col("cited_id")).join(bare, id_col, "left_semi")
    theirs = labels.select(F.col(id_col).alias("cited_id"), label)
    return cited.join(theirs, "cited_id").select(id_col, label).distinct()

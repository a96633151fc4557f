"""Upserts as set operations: the new state of a table from its old state and incoming rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(old: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """New rows replace old ones; among new rows of a key the largest ``version`` wins."""
    if version:
        new = new.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(version).desc()))).where("__r = 1").drop("__r")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def first_wins(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of known keys are ignored; among new rows of a key the first in ``order`` wins."""
    new = new.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__r = 1").drop("__r")
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def merged(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Full join on ``keys``; each other column by its rule over columns ``old.x`` and ``new.x``."""
    o, n = old.alias("old"), new.alias("new")
    both = o.join(n, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys], "full")
    return both.select(*[F.coalesce(f"old.{k}", f"new.{k}").alias(k) for k in keys], *[r.alias(c) for c, r in rules.items()])


def overwrite(c: str, key: str) -> Column:
    """The new value wherever there is a new row, null too; ``key`` is a key column of it."""
    return F.when(F.col(f"new.{key}").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))


def fill_only(c: str) -> Column:
    return F.coalesce(f"old.{c}", f"new.{c}")


def conditional_rename(c: str, placeholder: str = "Team ") -> Column:
    """A placeholder gives way to a real name; a real name never to a placeholder."""
    old, new = F.col(f"old.{c}"), F.col(f"new.{c}")
    return F.when(old.isNull() | (old.startswith(placeholder) & new.isNotNull()), new).otherwise(old)


def surrogate_keys(rows: DataFrame, natural: list[str], out: str) -> DataFrame:
    """Deterministic keys from 1 in natural order. The dimension is small beside its facts: one task numbers it."""
    return rows.select(*natural).distinct().withColumn(out, F.row_number().over(Window.orderBy(*natural)))


def scaffold(have: DataFrame, need: DataFrame, keys: list[str]) -> DataFrame:
    """``have`` and a row with nulls for every missing key of ``need``."""
    return have.unionByName(need.select(*keys).distinct().join(have.select(*keys), keys, "left_anti"), allowMissingColumns=True)

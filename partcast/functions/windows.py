"""Per-item window specifications (built on demand: a Window needs an active
Spark context, so none is created at import time)."""

from __future__ import annotations

from pyspark.sql import Window


def by_item(key: str = "item_id", order: str = "ds"):
    return Window.partitionBy(key).orderBy(order)


def item_all(key: str = "item_id"):
    return Window.partitionBy(key)


def upto(key: str = "item_id", order: str = "ds"):
    return by_item(key, order).rowsBetween(Window.unboundedPreceding, 0)


def before(key: str = "item_id", order: str = "ds"):
    return by_item(key, order).rowsBetween(Window.unboundedPreceding, -1)


def after(key: str = "item_id", order: str = "ds"):
    return by_item(key, order).rowsBetween(1, Window.unboundedFollowing)


def frame(k: int, key: str = "item_id", order: str = "ds"):
    """The last k rows including the current one (partial frames at the start)."""
    return by_item(key, order).rowsBetween(-(k - 1), 0)

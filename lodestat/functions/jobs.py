"""Small jobs side by side: planning one takes the driver longer than running it, and they don't depend on each other."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

A, B = TypeVar("A"), TypeVar("B")
AT_ONCE = 4


def each(work: Callable[[A], B], items: Iterable[A], at_once: int = AT_ONCE) -> list[B]:
    """work(item) of each, in the order of items; the first error is raised."""
    items = list(items)
    if len(items) < 2:
        return [work(x) for x in items]
    spark = SparkSession.getActiveSession()
    own = inheritable_thread_target(spark)(work) if spark else work
    with ThreadPoolExecutor(min(at_once, len(items))) as pool:
        return list(pool.map(own, items))

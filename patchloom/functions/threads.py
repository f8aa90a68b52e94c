"""Spark jobs side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target


def in_parallel(tasks: Sequence[Callable[[], object]], parallelism: int) -> list:
    """The tasks' results, some at a time in threads of the driver; the work is that of the jobs they start."""
    if len(tasks) < 2 or parallelism < 2:
        return [t() for t in tasks]
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return pool.map(inheritable_thread_target(lambda t: t()), tasks)

"""Deadlines: a query that takes too long is cancelled and fails, never cut short."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class DeadlineExceeded(RuntimeError):
    pass


@contextmanager
def deadline(spark: SparkSession, seconds: float):
    """Cancels the jobs that the body starts once the time is over."""
    sc = spark.sparkContext
    tag, over = f"deadline-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        over.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as e:
        if over.is_set():
            raise DeadlineExceeded(f"the query took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def collect_within(spark: SparkSession, seconds: float, query: Callable[[], DataFrame]) -> list:
    with deadline(spark, seconds):
        return query().collect()

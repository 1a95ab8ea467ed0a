"""Execution contexts: thin handles of a Spark session."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession


class Context:
    def __init__(self, spark: SparkSession, parallelism: int | None = None):
        self.spark, self._parallelism, self._active = spark, parallelism, True

    def is_active(self) -> bool:
        return self._active and not self.spark.sparkContext._jsc.sc().isStopped()

    def require_active(self) -> None:
        if not self.is_active():
            raise RuntimeError("the context is not active")

    def get_parallelism(self) -> int:
        return self._parallelism or self.spark.sparkContext.defaultParallelism

    def call(self, tasks: Sequence[Callable]) -> list:
        """Run jobs (driver-side callables) and give all results in order; the first failure is raised."""
        self.require_active()
        if self.get_parallelism() == 1:
            return [t() for t in tasks]
        with ThreadPoolExecutor(self.get_parallelism()) as pool:
            return [f.result() for f in [pool.submit(t) for t in tasks]]

    def single_threaded(self) -> Context:
        return Context(self.spark, 1)

    def stop(self) -> None:
        self._active = False


def default_context() -> Context:
    return Context(SparkSession.builder.config("spark.sql.caseSensitive", "true").getOrCreate())


def run(task: Callable | Sequence[Callable], context: Context):
    return context.call([task])[0] if callable(task) else context.call(task)


def parallel(start: int, end: int, task: Callable[[int], None], context: Context) -> None:
    context.call([lambda i=i: task(i) for i in range(start, end)])

"""Long grids in chunks: every chunk is one tagged job, finished ones stay, the rest can be cancelled.

Chunks are written one after the other as versions of a ``Store``, so what is finished survives a
cancelled run and a dead driver, and a later run goes on behind it.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from barloom.sources.store import Store


@dataclass(frozen=True)
class Progress:
    done: int
    chunks: int
    running_tasks: int
    finished_tasks: int
    cancelled: bool


class Chunked:
    """``work(chunk)`` for chunks 0 to n - 1, in order, in a thread; results below ``root``."""

    def __init__(self, spark: SparkSession, root: str, chunks: int, work: Callable[[int], DataFrame]):
        self.spark, self.store, self.chunks, self.work = spark, Store(spark, root), chunks, work
        self.group = f"chunks-{uuid.uuid4().hex}"
        self.stopped, self.failure = threading.Event(), None
        self.thread = threading.Thread(target=self._run, daemon=True)

    @staticmethod
    def _name(chunk: int) -> str:
        return f"chunk-{chunk:06d}"

    def start(self) -> Chunked:
        self.thread.start()
        return self

    def _run(self) -> None:
        sc = self.spark.sparkContext
        sc.setJobGroup(self.group, "chunks", interruptOnCancel=True)
        try:
            for chunk in range(self.chunks):
                if self.stopped.is_set():
                    return
                if self._name(chunk) not in self.store.manifest():
                    self.store.publish({self._name(chunk): self.work(chunk)})
        except Exception as e:
            if not self.stopped.is_set() or not isinstance(e, PySparkException) and "cancel" not in str(e).lower():
                self.failure = e

    def progress(self) -> Progress:
        tracker = self.spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(self.group) if (job := tracker.getJobInfo(j)) for s in job.stageIds]
        stages = [s for s in stages if s]
        return Progress(len(self.store.manifest()), self.chunks, sum(s.numActiveTasks for s in stages), sum(s.numCompletedTasks for s in stages), self.stopped.is_set())

    def cancel(self) -> None:
        """Stop the running jobs and start no more; finished chunks stay."""
        self.stopped.set()
        while self.thread.is_alive():
            self.spark.sparkContext.cancelJobGroup(self.group)
            self.thread.join(0.2)

    def wait(self) -> None:
        self.thread.join()
        if self.failure:
            raise self.failure

    def results(self) -> DataFrame | None:
        """Rows of all finished chunks; None before the first."""
        names = sorted(self.store.manifest())
        return reduce(DataFrame.unionByName, (self.store.read(n) for n in names)) if names else None

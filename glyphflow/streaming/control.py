"""Batch runs that can be watched and stopped."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Cancelled(Exception):
    """What ``Run.result`` raises of a run that was stopped."""


class Run:
    """An action (a function that makes Spark run jobs: a write, a count) in a thread of its own, under a tag of its own.

    ``stop`` cancels the jobs of the action and those that it still would start; Spark's writers commit at the end, so what was
    being written leaves no output. Runs beside it go on.
    """

    def __init__(self, spark: SparkSession, action: Callable[[], Any]):
        self.spark, self.tag, self.began = spark, f"run-{uuid.uuid4().hex}", time.time()
        self.stopped, self._value, self._error = False, None, None

        def work() -> None:
            spark.sparkContext.addJobTag(self.tag)
            try:
                self._value = action()
            except BaseException as e:  # whatever it is, whoever asks for the result gets it
                self._error = e
            finally:
                spark.sparkContext.removeJobTag(self.tag)

        self._thread = InheritableThread(target=work, session=spark)
        self._thread.daemon = True
        self._thread.start()

    def running(self) -> bool:
        return self._thread.is_alive()

    def stop(self, wait: float = 30.0) -> None:
        """Ends the run; while its thread lives, jobs that it starts are cancelled too."""
        self.stopped, until = self.running(), time.time() + wait
        while self.running() and time.time() < until:
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self._thread.join(0.3)

    def result(self) -> Any:
        """What the action returned, once it has ended; its error, or ``Cancelled`` if it was stopped."""
        self._thread.join()
        if self.stopped and self._error is not None:
            raise Cancelled(self.tag) from self._error
        if self._error is not None:
            raise self._error
        return self._value

    def progress(self) -> dict[str, float]:
        """jobs, tasks and done (tasks) of this run so far, seconds, and done tasks a second."""
        scala, jobs = self.spark.sparkContext._jsc.sc(), []
        tracker = self.spark.sparkContext.statusTracker()
        jobs = [int(j) for j in scala.statusTracker().getJobIdsForTag(self.tag)]
        infos = [tracker.getStageInfo(s) for j in jobs for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else [])]
        tasks, done = sum(i.numTasks for i in infos if i), sum(i.numCompletedTasks for i in infos if i)
        seconds = max(time.time() - self.began, 1e-9)
        return {"jobs": len(jobs), "tasks": tasks, "done": done, "seconds": seconds, "rate": done / seconds}


def ended(run: Run, stop: Callable[[], bool], seen: Callable[[dict], None] | None = None, every: float = 0.3) -> bool:
    """Waits for a run, and stops it as soon as ``stop()`` holds; whether it came to its own end. ``seen`` gets the progress."""
    while run.running():
        if seen is not None:
            seen(run.progress())
        if stop():
            run.stop()
            break
        run._thread.join(every)
    return not run.stopped

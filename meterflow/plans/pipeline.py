"""Named steps over DataFrames with dependencies. Spark does the work; this only orders the steps.

A step is a function of its dependencies' DataFrames. ``run`` returns one result per step: status
(``done``, ``failed``, ``skipped`` or ``dry``), seconds, rows and error. A failed step stops nothing but
the steps behind it.
"""

from __future__ import annotations

import functools
import json
import statistics
import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import asdict, dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass
class StepResult:
    name: str
    status: str
    seconds: float = 0.0
    rows: int | None = None
    error: str | None = None
    output: DataFrame | None = field(default=None, repr=False, compare=False)


class Pipeline:
    def __init__(self, spark: SparkSession, name: str = "pipeline"):
        self.spark, self.name = spark, name
        self.steps: dict[str, Callable] = {}
        self.needs: dict[str, tuple[str, ...]] = {}

    def add(self, name: str, step: Callable[..., DataFrame], needs: tuple[str, ...] | list[str] = ()) -> Pipeline:
        if name in self.steps:
            raise ValueError(f"step {name} exists")
        if unknown := [n for n in needs if n not in self.steps]:
            raise ValueError(f"unknown steps: {unknown}")
        self.steps[name], self.needs[name] = step, tuple(needs)
        return self

    def chain(self, *steps: tuple[str, Callable]) -> Pipeline:
        """Each step needs the one before it."""
        before: tuple[str, ...] = ()
        for name, step in steps:
            self.add(name, step, before)
            before = (name,)
        return self

    def order(self) -> list[str]:
        return list(TopologicalSorter(self.needs).static_order())

    def run(self, parallel: int = 4, dry: bool = False, sink: Callable[[str, DataFrame], DataFrame] | None = None) -> dict[str, StepResult]:
        """Run all steps. ``sink(name, df)`` writes a step's rows and returns how later steps read them."""
        graph, results = TopologicalSorter(self.needs), {}
        graph.prepare()
        with ThreadPoolExecutor(parallel) as pool:
            running = {}
            while graph.is_active():
                for name in graph.get_ready():
                    blocked = [n for n in self.needs[name] if results[n].status not in ("done", "dry")]
                    if blocked:
                        results[name] = StepResult(name, "skipped", error=f"needs {', '.join(blocked)}")
                        graph.done(name)
                    else:
                        inputs = [results[n].output for n in self.needs[name]]
                        running[pool.submit(self._step, name, inputs, dry, sink)] = name
                if not running:
                    continue
                for future in wait(running, return_when=FIRST_COMPLETED).done:
                    name = running.pop(future)
                    results[name] = future.result()
                    graph.done(name)
        return results

    def _step(self, name: str, inputs: list, dry: bool, sink) -> StepResult:
        began = time.monotonic()
        try:
            if dry:
                return StepResult(name, "dry")
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
            df, rows = self.steps[name](*inputs), None
            if sink is not None:
                seen = Observation()
                df = sink(name, df.observe(seen, F.count(F.lit(1)).alias("rows")))
                rows = seen.get["rows"]
            return StepResult(name, "done", time.monotonic() - began, rows, output=df)
        except Exception as e:  # noqa: BLE001  a step may fail in any way; the others go on
            return StepResult(name, "failed", time.monotonic() - began, error=f"{type(e).__name__}: {e}"[:2000])


def summary(results: dict[str, StepResult]) -> dict:
    """Counts by status, total rows of the last steps, mean and median seconds."""
    seconds = [r.seconds for r in results.values() if r.status == "done"]
    by = {s: sum(r.status == s for r in results.values()) for s in ("done", "failed", "skipped", "dry")}
    return by | {"success": not by["failed"] and not by["skipped"], "mean_s": statistics.fmean(seconds) if seconds else 0.0, "median_s": statistics.median(seconds) if seconds else 0.0}


def to_json(results: dict[str, StepResult]) -> str:
    rows = [{k: v for k, v in vars(r).items() if k != "output"} for r in results.values()]
    return json.dumps({"summary": summary(results), "steps": rows}, indent=1)


@dataclass
class Timing:
    name: str
    seconds: float
    rows: int
    rows_per_second: float


def timed(step: Callable[..., DataFrame]) -> Callable[..., Timing]:
    """Run a step's whole plan without keeping its rows, and report how long it took."""

    @functools.wraps(step)
    def run(*args, **kwargs) -> Timing:
        began, seen = time.monotonic(), Observation()
        step(*args, **kwargs).observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        seconds, rows = time.monotonic() - began, seen.get["rows"]
        return Timing(step.__name__, seconds, rows, rows / max(seconds, 1e-9))

    return run


def as_dict(timing: Timing) -> dict:
    return asdict(timing)

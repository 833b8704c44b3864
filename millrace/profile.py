"""A tree of timed steps with counts of rows and batches (the parts that a result came in)."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Step:
    name: str
    began: float = 0.0
    seconds: float = 0.0
    rows: int | None = None
    batches: int | None = None
    steps: list[Step] = field(default_factory=list)

    @property
    def own_seconds(self) -> float:
        """Without the steps inside."""
        return self.seconds - sum(s.seconds for s in self.steps)

    def lines(self, depth: int = 0) -> list[str]:
        rows = "" if self.rows is None else f", {self.rows} rows"
        rows += "" if self.batches is None else f", {self.batches} batches"
        return [f"{'  ' * depth}{self.name}: {self.seconds:.3f} s (own {self.own_seconds:.3f} s){rows}", *(x for s in self.steps for x in s.lines(depth + 1))]


class Profiler:
    """``with profiler.step(name)``: steps nest; ``stop`` freezes the tree."""

    def __init__(self, name: str = "query"):
        self.root = Step(name, time.perf_counter())
        self._open = [self.root]
        self.stopped = False

    @contextmanager
    def step(self, name: str):
        if self.stopped:
            raise RuntimeError("the profiler is stopped")
        step = Step(name, time.perf_counter())
        self._open[-1].steps.append(step)
        self._open.append(step)
        try:
            yield step
        finally:
            step.seconds = time.perf_counter() - step.began
            self._open.pop()

    def counted(self, df: DataFrame, step: Step) -> tuple[DataFrame, Observation]:
        """The frame with its rows counted while an action runs it: no extra pass."""
        seen = Observation(f"{step.name}-{id(step)}")
        part = F.spark_partition_id()
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(part).alias("last")), seen

    def run(self, name: str, df: DataFrame, action) -> object:
        """``action`` on the frame as a step with its time and rows."""
        with self.step(name) as step:
            counted, seen = self.counted(df, step)
            result = action(counted)
            step.rows = seen.get["rows"]
            step.batches = 0 if seen.get["last"] is None else seen.get["last"] + 1
        return result

    def stop(self) -> Step:
        if not self.stopped:
            self.root.seconds = time.perf_counter() - self.root.began
            self.stopped = True
        return self.root

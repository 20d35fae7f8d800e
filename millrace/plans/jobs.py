"""Job plans: atomic steps, chains, split/merge and alternatives, compiled to DataFrame transformations."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]


class Job:
    """A step from DataFrame to DataFrame that some nodes support at some expected cost."""

    def supported(self, node: str | None = None) -> bool:
        raise NotImplementedError

    def cost(self, node: str | None = None) -> float:
        """Expected seconds of one item; infinite where unsupported, 0 where nothing is known."""
        raise NotImplementedError

    def steps(self) -> list[Job]:
        """The flattened list of steps that run one after another."""
        return [self]

    def run(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


@dataclass(eq=False)
class Atomic(Job):
    """One transformation. An unpredictable one is repartitioned first, so that uneven rows spread over all tasks."""

    transform: Transform
    name: str = ""
    on: Callable[[str | None], bool] = lambda node: True
    seconds: float | None = None
    unpredictable: bool = False

    def supported(self, node=None):
        return self.on(node)

    def cost(self, node=None):
        return (self.seconds or 0.0) if self.supported(node) else math.inf

    def run(self, df):
        return (df.repartition(df.sparkSession.sparkContext.defaultParallelism) if self.unpredictable else df).transform(self.transform)


class Series(Job):
    """A chain; chains inside it are flattened, and Catalyst fuses the narrow steps into one stage."""

    def __init__(self, *jobs: Job):
        self.jobs = jobs

    def steps(self):
        return [s for j in self.jobs for s in j.steps()]

    def supported(self, node=None):
        # Later steps may run on other nodes, so the first decides.
        steps = self.steps()
        return not steps or steps[0].supported(node)

    def cost(self, node=None):
        return sum(c for s in self.steps() if not math.isinf(c := s.cost(node)))

    def run(self, df):
        for step in self.steps():
            df = step.run(df)
        return df


@dataclass(eq=False)
class Parallel(Job):
    """Split each row into parts, run a job on the parts, merge parts of a row again.

    split: column expression giving an array of part values. The child sees `key`, `part_ix` and `part`. merge: aggregate
    expressions over the child's output, by key. A row without parts has no merged row.
    """

    key: str
    split: Callable[[DataFrame], Column]
    child: Job
    merge: Callable[[], Iterable[Column]]
    name: str = ""

    def supported(self, node=None):
        return self.child.supported(node)

    def cost(self, node=None):
        return self.child.cost(node)

    def run(self, df):
        parts = df.select(self.key, F.posexplode(self.split(df)).alias("part_ix", "part"))
        return self.child.run(parts).groupBy(self.key).agg(*self.merge())


@dataclass(eq=False)
class ParallelInRow(Job):
    """Split, work and merge inside a row: for children that are column functions of a part, so that no part is shuffled.

    split: column expression giving an array of part values. child: result column from (part, part_ix), a struct or any
    value. merge: named columns from the array of results, in the order of the parts.
    """

    split: Callable[[DataFrame], Column]
    child: Callable[[Column, Column], Column]
    merge: Callable[[Column], Iterable[Column]]
    name: str = ""

    def run(self, df):
        worked = df.withColumn("_parts", self.split(df)).withColumn("_results", F.transform("_parts", self.child)).drop("_parts")
        return worked.select(*(c for c in worked.columns if c != "_results"), *self.merge(F.col("_results")))


class Alternatives(Job):
    """Equivalent implementations; the cheapest supported one runs, the first of equals."""

    def __init__(self, *jobs: Job):
        self.jobs = jobs

    def choose(self, node=None) -> Job:
        able = [j for j in self.jobs if j.supported(node)]
        if not able:
            raise ValueError("no alternative is supported")
        return min(able, key=lambda j: j.cost(node))

    def supported(self, node=None):
        return any(j.supported(node) for j in self.jobs)

    def cost(self, node=None):
        return min((j.cost(node) for j in self.jobs if j.supported(node)), default=math.inf)

    def run(self, df):
        return self.choose().run(df)


@dataclass(frozen=True)
class JobType:
    index: int
    atomic: bool
    unpredictable: bool


@dataclass
class Catalog:
    """Dense numbers for jobs, children first; registering a job again changes nothing."""

    types: dict[int, JobType] = field(default_factory=dict)
    todo: dict[int, list[int]] = field(default_factory=dict)
    _jobs: list[Job] = field(default_factory=list)

    def __len__(self):
        return len(self.types)

    def register(self, job: Job) -> JobType:
        if id(job) in self.types:
            return self.types[id(job)]
        children = list(job.jobs) if isinstance(job, Series | Alternatives) else [job.child] if isinstance(job, Parallel) else []
        for child in children:
            self.register(child)
        kind = JobType(len(self.types), isinstance(job, Atomic), isinstance(job, Parallel) or getattr(job, "unpredictable", False))
        self.types[id(job)] = kind
        self._jobs.append(job)
        self.todo[kind.index] = [t for c in children for t in self.todo[self.types[id(c)].index]] if isinstance(job, Series) else [kind.index]
        return kind

    def stage(self, job: Job, n: int) -> int:
        """Number of the n-th step of a job."""
        return self.todo[self.register(job).index][n]

    def initial_costs(self, node: str | None = None) -> list[float]:
        return [j.cost(node) for j in self._jobs]

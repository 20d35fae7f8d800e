"""The pipeline text language: components, pipelines of stages with widths, options, filesets, deployment.

    component NAME kind                      a stage kind from the registry
    options NAME key=value ...               options of a component
    fileset (check|nocheck) NAME dir/pre%%%post
    pipeline NAME (WIDTH [get:]component[:put]) ...
    deploy PIPELINE
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class PipelineError(ValueError):
    """Text that can't be compiled; the message says where and why."""


@dataclass(frozen=True)
class Stage:
    width: int
    component: str
    get: int = 1
    put: int = 1


@dataclass(frozen=True)
class Fileset:
    check: bool
    directory: str
    prefix: str
    postfix: str
    positions: int


@dataclass(frozen=True)
class Kind:
    """A registered stage kind: its row types and its transformation."""

    takes: str | None
    gives: str | None
    run: Callable[[DataFrame, Options], DataFrame] | None = None


class Options(dict):
    """Typed access to key=value options."""

    def typed(self, key: str, kind: type, default=None, required: bool = False):
        if key not in self:
            if required:
                raise PipelineError(f"option {key} is missing")
            return default
        try:
            return self[key].lower() in ("1", "true", "yes", "on") if kind is bool else kind(self[key])
        except ValueError as e:
            raise PipelineError(f"option {key}={self[key]} isn't {kind.__name__}") from e


#: Row types, each with the type it is a kind of.
PARENTS = {"rgb24": "image", "rgb48": "image", "compressed": "image", "image": None}
KINDS: dict[str, Kind] = {}


def stage_kind(name: str, takes: str | None, gives: str | None):
    def add(fn):
        KINDS[name] = Kind(takes, gives, fn)
        return fn

    return add


def is_a(given: str | None, wanted: str | None) -> bool:
    while given is not None and given != wanted:
        given = PARENTS.get(given)
    return given is not None and given == wanted


def parse_fileset(text: str, check: bool = False) -> Fileset:
    m = re.fullmatch(r"(?:(.*)/)?([^/%]*)(%+)([^/%]*)", text)
    if not m:
        raise PipelineError(f"fileset pattern {text!r} needs one run of %")
    return Fileset(check, m[1] or ".", m[2], m[4], len(m[3]))


@dataclass
class Config:
    components: dict[str, str] = field(default_factory=dict)
    options: dict[str, Options] = field(default_factory=dict)
    pipelines: dict[str, list[Stage]] = field(default_factory=dict)
    filesets: dict[str, Fileset] = field(default_factory=dict)
    clusters: dict[str, list[str]] = field(default_factory=dict)
    deployed: str | None = None

    def stages(self) -> list[Stage]:
        if self.deployed is None:
            raise PipelineError("nothing is deployed")
        return self.pipelines[self.deployed]


def parse(text: str) -> Config:
    config = Config()
    for number, line in enumerate(text.splitlines(), 1):
        words = line.split("#", 1)[0].split()
        if not words:
            continue
        try:
            _line(config, words)
        except PipelineError as e:
            raise PipelineError(f"line {number}: {e}") from None
    return config


def _line(config: Config, words: list[str]) -> None:
    keyword, rest = words[0], words[1:]
    if keyword == "component" and len(rest) == 2:
        if rest[0] in config.components:
            raise PipelineError(f"component {rest[0]} is defined twice")
        config.components[rest[0]] = rest[1]
    elif keyword == "cluster" and rest:
        config.clusters[rest[0]] = rest[1:]
    elif keyword == "options" and rest:
        own = config.options.setdefault(rest[0], Options())
        for pair in rest[1:]:
            key, eq, value = pair.partition("=")
            if not eq or key in own:
                raise PipelineError(f"option {key} is given twice" if eq else f"{pair} isn't key=value")
            own[key] = value
    elif keyword == "fileset" and len(rest) == 3 and rest[0] in ("check", "nocheck"):
        config.filesets[rest[1]] = parse_fileset(rest[2], rest[0] == "check")
    elif keyword == "pipeline" and len(rest) >= 3 and len(rest) % 2:
        if rest[0] in config.pipelines:
            raise PipelineError(f"pipeline {rest[0]} is defined twice")
        config.pipelines[rest[0]] = [_stage(config, w, s) for w, s in zip(rest[1::2], rest[2::2], strict=True)]
    elif keyword == "deploy" and len(rest) == 1:
        if rest[0] not in config.pipelines:
            raise PipelineError(f"pipeline {rest[0]} is unknown")
        config.deployed = rest[0]
    else:
        raise PipelineError(f"can't read {' '.join(words)!r}")


def _stage(config: Config, width: str, said: str) -> Stage:
    m = re.fullmatch(r"(?:(\d+):)?([A-Za-z_]\w*)(?::(\d+))?", said)
    if not m or not width.isdigit() or int(width) < 1:
        raise PipelineError(f"stage {width} {said} can't be read")
    if m[2] not in config.components:
        raise PipelineError(f"component {m[2]} is unknown")
    return Stage(int(width), m[2], int(m[1] or 1), int(m[3] or 1))


@dataclass(frozen=True)
class Component:
    number: int
    name: str
    stage: int
    rank: int
    size: int
    get_name: str | None
    put_name: str | None


@dataclass(frozen=True)
class Queue:
    name: str
    kind: str
    put: tuple[str, ...]
    get: tuple[str, ...]
    length: int


def compile_pipeline(config: Config) -> tuple[list[Component], list[Queue]]:
    """Components and the queues between them; widths must divide and types must fit."""
    stages = config.stages()
    kinds = [KINDS.get(config.components[s.component]) for s in stages]
    for s, k in zip(stages, kinds, strict=True):
        if k is None:
            raise PipelineError(f"component {s.component} has the unknown kind {config.components[s.component]}")
    queues: list[Queue] = []
    for i, (a, b) in enumerate(zip(stages, stages[1:], strict=False)):
        if not is_a(kinds[i].gives, kinds[i + 1].takes):
            raise PipelineError(f"{a.component} gives {kinds[i].gives}, {b.component} takes {kinds[i + 1].takes}")
        if max(a.width, b.width) % min(a.width, b.width):
            raise PipelineError(f"widths {a.width} and {b.width} don't divide")
        length = max(a.put, b.get)
        for j in range(min(a.width, b.width)):
            puts = tuple(f"put.{i}.{x}" for x in range(j, a.width, b.width)) if a.width > b.width else (f"put.{i}.{j}",)
            gets = tuple(f"get.{i + 1}.{x}" for x in range(j, b.width, a.width)) if b.width > a.width else (f"get.{i + 1}.{j}",)
            kind = "simple" if a.width == b.width else "split" if b.width > a.width else "merge"
            queues.append(Queue(f"q.{i}.{j}", kind, puts, gets, length))
    components, number = [], 0
    for i, s in enumerate(stages):
        for rank in range(s.width):
            get = f"get.{i}.{rank}" if i else None
            put = f"put.{i}.{rank}" if i < len(stages) - 1 else None
            components.append(Component(number, s.component, i, rank, s.width, get, put))
            number += 1
    return components, queues


def as_frames(spark: SparkSession, config: Config) -> tuple[DataFrame, DataFrame]:
    components, queues = compile_pipeline(config)
    return (
        spark.createDataFrame([vars(c) for c in components], "number int, name string, stage int, rank int, size int, get_name string, put_name string"),
        spark.createDataFrame([(q.name, q.kind, list(q.put), list(q.get), q.length) for q in queues], "name string, type string, put array<string>, get array<string>, length int"),
    )


def run_pipeline(config: Config, source: DataFrame, number: str = "number") -> DataFrame:
    """Run the deployed stages on a DataFrame of items.

    A stage's width is the number of partitions its items are dealt to by their number; equal widths stay where they
    are. Order is kept by the number, not by arrival.
    """
    df, width = source, None
    compile_pipeline(config)
    for s in config.stages():
        if s.width != width and width is not None:
            df = df.repartition(s.width, F.pmod(F.col(number), F.lit(s.width)))
        width = s.width
        kind = KINDS[config.components[s.component]]
        if kind.run is not None:
            df = kind.run(df, config.options.get(s.component, Options()))
    return df

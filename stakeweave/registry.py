"""Source registry: named runs, one failing without stopping the rest, and locks by version folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Source:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    kind: str = "instant"
    depth_aware: bool = False
    enabled: bool = True


_sources: dict[str, Source] = {}


def register(source: Source) -> Source:
    _sources[source.name] = source
    return source


def registered(kind: str | None = None, deepening: bool = False) -> list[Source]:
    """Enabled sources in order of registration; a deepening run takes the depth-aware ones only."""
    return [s for s in _sources.values() if s.enabled and (kind is None or s.kind == kind) and (s.depth_aware or not deepening)]


def run_all(spark: SparkSession, target: str, kind: str | None = None, deepening: bool = False) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Results and errors of every source that applies."""
    done, failed = {}, {}
    for source in registered(kind, deepening):
        try:
            done[source.name] = source.run(spark, target)
        except Exception as error:  # one source must not stop the others
            failed[source.name] = str(error)
    return done, failed

"""Registry of source plugins: a name and a function from (session, options) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Source = Callable[[SparkSession, dict], DataFrame]
_SOURCES: dict[str, Source] = {}


def register(name: str) -> Callable[[Source], Source]:
    def add(f: Source) -> Source:
        if name in _SOURCES:
            raise ValueError(f"source {name!r} is registered already")
        _SOURCES[name] = f
        return f

    return add


def source(name: str) -> Source:
    if name not in _SOURCES:
        raise KeyError(f"no source {name!r}; there are {sorted(_SOURCES)}")
    return _SOURCES[name]


def names() -> list[str]:
    return sorted(_SOURCES)


def collect(spark: SparkSession, options: dict[str, dict]) -> DataFrame:
    """All named sources in one DataFrame, tagged with their name; columns that a source lacks are null."""
    out: DataFrame | None = None
    for name, opts in options.items():
        from pyspark.sql import functions as F

        df = source(name)(spark, opts).withColumn("origin", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source given")
    return out

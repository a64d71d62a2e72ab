"""Functions of a user's own over ensembles, runs, states and columns, and order parameters by name.

The first three hand pandas tables to the function, one per group, so a group must fit in one task's memory: a state or a
run does; an ensemble should be given by its states, not its particles. The ``_in_batches`` forms hand the function a group's batches one
at a time, so that a group of any size passes. What columns can express needs none of them.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame

from rodfield.config import KEY, SIM

Table = Callable[[pd.DataFrame], pd.DataFrame]
Batches = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {}


def per_ensemble(df: DataFrame, f: Table, schema: str) -> DataFrame:
    return df.groupBy("ensemble_id").applyInPandas(f, schema)


def per_simulation(df: DataFrame, f: Table, schema: str) -> DataFrame:
    return df.groupBy(*SIM).applyInPandas(f, schema)


def per_state(df: DataFrame, f: Table, schema: str) -> DataFrame:
    return df.groupBy(*KEY).applyInPandas(f, schema)


def _in_batches(df: DataFrame, by: list[str], f: Batches, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from f(batches)

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}  # the kind of function is told by its types
    return df.groupBy(*by).applyInPandas(run, schema)


def per_ensemble_in_batches(df: DataFrame, f: Batches, schema: str) -> DataFrame:
    return _in_batches(df, ["ensemble_id"], f, schema)


def per_simulation_in_batches(df: DataFrame, f: Batches, schema: str) -> DataFrame:
    """A run's rows come in no order that the function may rely on."""
    return _in_batches(df, SIM, f, schema)


def per_state_in_batches(df: DataFrame, f: Batches, schema: str) -> DataFrame:
    return _in_batches(df, KEY, f, schema)


def every_column(f: Callable[[str], Column], columns: list[str]) -> list[Column]:
    """The same function of each column, under its name."""
    return [f(c).alias(c) for c in columns]


def order(name: str):
    """Registers an order parameter: a function of particles that adds a column of that name."""
    def add(f: Callable[[DataFrame], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"order parameter {name!r} is registered")
        REGISTRY[name] = f
        return f

    return add


def order_parameter(particles: DataFrame, name: str) -> DataFrame:
    if name not in REGISTRY:
        raise ValueError(f"unknown order parameter {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](particles)

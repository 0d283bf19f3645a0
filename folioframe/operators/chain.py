"""Processors: named functions on a document's tables, run in a fixed order behind configuration gates."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Processor:
    """A function from tables (and settings that it names) to the tables it changes. `gate`: the setting that switches it."""

    name: str
    run: Callable[..., Tables]
    gate: str | None = None
    default: bool = True


def named(path: str) -> Callable[..., Tables]:
    """The function that a dotted path names: a plug-in."""
    module, _, name = path.rpartition(".")
    return getattr(import_module(module), name)


def run(tables: Tables, processors: Sequence[Processor | str], config: Mapping[str, object] | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """The tables after all processors whose gate is open, and the names of those that ran.

    A processor gets the tables and, by name, the settings that its parameters ask for; a table that is not there
    skips a processor that asks for it. Nothing runs but plans: all processors become one plan per table.
    """
    now, ran, settings = dict(tables), [], dict(config or {})
    for given in processors:
        step = Processor(given.rpartition(".")[2], named(given)) if isinstance(given, str) else given
        if step.gate and not settings.get(step.gate, step.default):
            continue
        wanted = inspect.signature(step.run).parameters
        if any(p.default is p.empty and name not in now and name not in settings for name, p in wanted.items()):
            continue
        now |= step.run(**{name: now.get(name, settings.get(name)) for name in wanted if name in now or name in settings})
        ran.append(step.name)
    return now, ran

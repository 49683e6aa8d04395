"""Pipelines of operators from Python or from a config file.

A pipeline is a list of functions from DataFrame to DataFrame: running it builds
one lazy plan, which the optimizer prunes as a whole.  A config names functions
of the operator modules and their arguments; ``@config:/operators/name`` stands
for another entry of the file, overrides replace single values.
"""

from __future__ import annotations

import importlib
import json
import tomllib
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]
#: Only functions of these modules can be named.
MODULES = ("containers", "mapping", "flagging", "filters", "sequences", "simulate", "pointing")


def pipeline(*steps: Step) -> Step:
    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df

    return run


def read_config(path: str) -> dict[str, Any]:
    text = Path(path).read_text()
    return json.loads(text) if path.endswith(".json") else tomllib.loads(text)


def merge(config: Mapping[str, Any], overrides: Mapping[str, Any]) -> dict[str, Any]:
    """overrides: {"operators.name.argument": value}."""
    out = json.loads(json.dumps(config))
    for dotted, value in overrides.items():
        at = out
        *path, last = dotted.split(".")
        for key in path:
            at = at.setdefault(key, {})
        at[last] = value
    return out


def build(config: Mapping[str, Any], name: str) -> Step:
    """The step that an entry of ``operators`` describes: {"function": "module.name", argument: value}, or {"steps": [...]}."""
    return _build(config, name, ())


def _build(config: Mapping[str, Any], name: str, above: Sequence[str]) -> Step:
    if name in above:
        raise ValueError(f"operator {name} refers to itself")
    entry = dict(config["operators"][name])
    if "steps" in entry:
        return pipeline(*(_build(config, str(s).removeprefix("@config:/operators/"), (*above, name)) for s in entry["steps"]))
    module, _, function = entry.pop("function").partition(".")
    if module not in MODULES or function.startswith("_"):
        raise ValueError(f"no operator {module}.{function}")
    f = getattr(importlib.import_module(f"tideline.operators.{module}"), function)
    return lambda df: f(df, **entry)


def compare(a: Mapping[str, Any], b: Mapping[str, Any], at: str = "") -> list[tuple[str, Any, Any]]:
    """(path, value, other value) of all entries in which two configs differ."""
    out = []
    for key in sorted({*a, *b}):
        x, y, path = a.get(key), b.get(key), f"{at}/{key}"
        if isinstance(x, Mapping) and isinstance(y, Mapping):
            out += compare(x, y, path)
        elif x != y:
            out.append((path, x, y))
    return out

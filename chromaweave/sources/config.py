"""Simulation options from TOML, and back."""

from __future__ import annotations

import dataclasses
import json
import tomllib

from chromaweave.operators.simulation import SimulationConfig


def config_from_toml(text: str) -> SimulationConfig:
    """Options of the [simulate] table, or of the top level; unknown names are errors."""
    table = tomllib.loads(text)
    table = table.get("simulate", table)
    known = {f.name for f in dataclasses.fields(SimulationConfig)}
    if unknown := set(table) - known:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    return SimulationConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in table.items()})


def config_to_toml(config: SimulationConfig) -> str:
    def shown(value) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        return json.dumps(list(value) if isinstance(value, tuple) else value)

    return "[simulate]\n" + "".join(f"{k} = {shown(v)}\n" for k, v in dataclasses.asdict(config).items() if v is not None)


def config_to_json(config: SimulationConfig) -> str:
    return json.dumps(dataclasses.asdict(config))

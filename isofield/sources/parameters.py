"""Parameter files: ``key = value;`` with nested braces, comments and any key order."""

from __future__ import annotations

import re
from typing import Any

_TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|(?P<text>"[^"]*")|(?P<mark>[={},;])|(?P<word>[^\s={},;"]+)', re.S)

#: Other spellings of a key, and keys that have an effect no more.
ALIASES = {"GeometryFile": "geometry_file", "GeometryFiles": "geometry_files", "OutputPath": "output_path", "default_disk_orientation": "default_disc_orientation", "max_extended_starting_postion": "max_extended_starting_position", "ALD_step": "ald_step"}
IGNORED = {"process_cycles", "domain_extension", "process_distance", "afm_start_position", "afm_end_position", "grow_new_oxide"}
REQUIRED = {"cfl_condition", "grid_delta", "default_disc_orientation", "num_dimensions", "boundary_conditions"}
DEFAULTS: dict[str, Any] = {"input_scale": 1.0, "receptor_radius": 0.8, "further_tracking_distance": 3.0, "bits_per_distance": 8, "random_seed": 0, "remove_bottom": True, "add_layer": 0, "process_time": 0.0, "iteration_cycles": 0, "start_iteration_cycles": 0}


def _value(word: str) -> Any:
    if word[0] == '"':
        return word[1:-1]
    if word in ("true", "false"):
        return word == "true"
    try:
        return int(word)
    except ValueError:
        try:
            return float(word)
        except ValueError:
            return word


def parse(text: str) -> dict[str, Any]:
    """The settings of a file as nested dicts and lists. A list may separate its entries by commas or not; a repeated key is an error."""
    tokens = [m.group("text") or m.group("mark") or m.group("word") for m in _TOKEN.finditer(text) if m.lastgroup]
    at = 0

    def block(closing: bool) -> Any:
        nonlocal at
        named: dict[str, Any] = {}
        listed: list[Any] = []
        while at < len(tokens):
            t = tokens[at]
            if t == "}":
                if not closing:
                    raise ValueError("a closing brace too many")
                at += 1
                break
            if t in ",;":
                at += 1
            elif t == "{":
                at += 1
                listed.append(block(True))
            elif at + 1 < len(tokens) and tokens[at + 1] == "=":
                key = ALIASES.get(t, t)
                at += 2
                if at >= len(tokens):
                    raise ValueError(f"no value for {key}")
                if key in named:
                    raise ValueError(f"{key} is set twice")
                if tokens[at] == "{":
                    at += 1
                    named[key] = block(True)
                else:
                    named[key] = _value(tokens[at])
                    at += 1
            elif t == "=":
                raise ValueError("a value without a key")
            else:
                listed.append(_value(t))
                at += 1
        else:
            if closing:
                raise ValueError("a brace is not closed")
        if named and listed:
            raise ValueError(f"settings and values mixed near {next(iter(named))}")
        return named or listed

    return block(False) or {}


def read(path: str) -> dict[str, Any]:
    """The settings of a file with defaults; raises ValueError if a required key is missing."""
    with open(path) as f:
        found = parse(f.read())
    missing = REQUIRED - found.keys()
    if not found.keys() & {"geometry_file", "geometry_files"}:
        missing.add("geometry_file")
    if missing:
        raise ValueError(f"missing: {', '.join(sorted(missing))}")
    return DEFAULTS | found


def output_times(process: dict[str, Any]) -> list[float]:
    """Times of output of a process: those stated, repeated by period, the start and the end if asked for; sorted, each once."""
    times = list(process.get("output_times", []))
    end, period = float(process.get("process_time", 0)), float(process.get("output_times_period_length", 0))
    every = int(process.get("output_times_periodicity", 1))
    out = {t + i * period for t in times for i in range(every if period else 1)}
    if process.get("initial_output"):
        out.add(0.0)
    if process.get("final_output"):
        out.add(end)
    return sorted(float(t) for t in out if 0 <= t <= end)

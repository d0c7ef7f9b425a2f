"""Settings with their origin: an argument counts before the environment, that before a file, that before the default."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Spec:
    name: str
    kind: type
    default: object = None
    choices: tuple = ()
    low: int | None = None
    high: int | None = None
    prefixes: tuple[str, ...] = ()

    @property
    def env(self) -> str:
        return "QUOIN_" + self.name.replace(".", "_").upper()


# What can be set, and to what.
SPECS = (
    Spec("judge.model", str), Spec("judge.permutations", int, 2, (1, 2, 4, 6, 8, 10, 12, 14, 16)), Spec("judge.hurdle", int, 60, (), 0, 100),
    Spec("ingest.tier", str, "auto", ("auto", "pdftotext", "xberg", "docling", "marker")), Spec("ingest.verify", bool, True), Spec("ingest.docling_url", str, prefixes=("http://", "https://")),
    Spec("ingest.marker_url", str, prefixes=("http://", "https://")), Spec("ingest.marker_mode", str, "fast", ("fast", "balanced")),
)
BY_NAME = {s.name: s for s in SPECS}


@dataclass(frozen=True)
class Setting:
    name: str
    value: object
    source: str


def _sound(spec: Spec, value: object, where: str) -> object:
    if isinstance(value, bool) is not (spec.kind is bool) or not isinstance(value, spec.kind):
        raise ValueError(f"{spec.name} in {where} must be a {spec.kind.__name__}, not {value!r}")
    if spec.choices and value not in spec.choices:
        raise ValueError(f"{spec.name} in {where} must be one of {spec.choices}, not {value!r}")
    if spec.low is not None and not spec.low <= value <= spec.high:
        raise ValueError(f"{spec.name} in {where} must be from {spec.low} to {spec.high}, not {value!r}")
    if spec.prefixes and not value.startswith(spec.prefixes):
        raise ValueError(f"{spec.name} in {where} must begin with one of {spec.prefixes}")
    return value


def _of_text(spec: Spec, text: str) -> object:
    words = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}
    if spec.kind is bool:
        return words.get(text.strip().lower(), text)
    return int(text) if spec.kind is int and text.strip().lstrip("-").isdecimal() else text


def load(text: str) -> dict[str, object]:
    """Settings of a TOML text by name; names that are no settings are refused."""
    found = {f"{section}.{key}": v for section, own in tomllib.loads(text).items() for key, v in (own.items() if isinstance(own, dict) else [("", own)])}
    if unknown := sorted(set(found) - set(BY_NAME)):
        raise ValueError(f"unknown settings {unknown}")
    return found


def resolve(arguments: Mapping[str, object] | None = None, file: Mapping[str, object] | None = None, environment: Mapping[str, str] | None = None) -> dict[str, Setting]:
    """Each setting by name with the place that won. An argument of None isn't given; an empty variable isn't set."""
    arguments, file, environment = arguments or {}, file or {}, os.environ if environment is None else environment
    if unknown := sorted((set(arguments) | set(file)) - set(BY_NAME)):
        raise ValueError(f"unknown settings {unknown}")
    out = {}
    for s in SPECS:
        if arguments.get(s.name) is not None:
            out[s.name] = Setting(s.name, _sound(s, arguments[s.name], "an argument"), "argument")
        elif environment.get(s.env):
            out[s.name] = Setting(s.name, _sound(s, _of_text(s, environment[s.env]), s.env), "environment")
        elif s.name in file:
            out[s.name] = Setting(s.name, _sound(s, file[s.name], "the file"), "file")
        else:
            out[s.name] = Setting(s.name, s.default, "unset" if s.default is None else "default")
    return out

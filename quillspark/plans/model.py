"""Configurations as data: components with parameters, and the errors they raise."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


class QuillError(Exception):
    """Base of this package's errors."""


class UnknownComponent(QuillError, KeyError):
    """No component of that kind has that name."""


class DuplicateComponent(QuillError):
    """A component of that kind and name exists already."""


class BadParameter(QuillError, ValueError):
    """A parameter is unknown, of the wrong type or out of range."""


class BadPipeline(QuillError, ValueError):
    """A configuration that cannot run."""


class LoadError(QuillError):
    """A document could not be read."""


_TRUE, _FALSE = {"true", "1", "yes", "on"}, {"false", "0", "no", "off"}


@dataclass(frozen=True)
class Param:
    """A declared parameter: default, type (that of the default), range or choices."""

    name: str
    default: Any
    low: float | None = None
    high: float | None = None
    choices: tuple = ()
    about: str = ""

    def parse(self, value: Any) -> Any:
        kind = type(self.default)
        try:
            if kind is bool and isinstance(value, str):
                word = value.strip().lower()
                if word not in _TRUE | _FALSE:
                    raise ValueError(value)
                value = word in _TRUE
            else:
                value = kind(value)
        except (TypeError, ValueError) as e:
            raise BadParameter(f"{self.name}: {value!r} is not {kind.__name__}") from e
        if self.choices and value not in self.choices:
            raise BadParameter(f"{self.name}: {value!r} is none of {self.choices}")
        if self.low is not None and value < self.low or self.high is not None and value > self.high:
            raise BadParameter(f"{self.name}: {value!r} is not within {self.low}..{self.high}")
        return value


@dataclass(frozen=True)
class Component:
    kind: str
    name: str
    build: Callable[..., Any]
    params: tuple[Param, ...] = ()
    about: str = ""
    traits: frozenset = frozenset()

    def create(self, given: dict[str, Any] | None = None) -> Any:
        given = dict(given or {})
        known = {p.name: p for p in self.params}
        if extra := sorted(set(given) - set(known)):
            raise BadParameter(f"{self.kind} {self.name} has no parameter {', '.join(extra)}")
        return self.build(**{n: p.parse(given.get(n, p.default)) for n, p in known.items()})


class Registry:
    """Named components of one kind; extensible by users."""

    def __init__(self, kind: str):
        self.kind = kind
        self.items: dict[str, Component] = {}

    def register(self, name: str, *params: Param, about: str = "", traits: tuple[str, ...] = ()) -> Callable:
        def put(build: Callable) -> Callable:
            if name in self.items:
                raise DuplicateComponent(f"{self.kind} {name} exists already")
            self.items[name] = Component(self.kind, name, build, params, about or (build.__doc__ or "").strip().split("\n")[0], frozenset(traits))
            return build

        return put

    def get(self, name: str) -> Component:
        if name not in self.items:
            raise UnknownComponent(f"no {self.kind} named {name}; there are {', '.join(sorted(self.items))}")
        return self.items[name]

    def create(self, name: str, params: dict[str, Any] | None = None) -> Any:
        return self.get(name).create(params)

    def names(self) -> list[str]:
        return sorted(self.items)

    def describe(self) -> list[dict[str, Any]]:
        return [
            {"kind": c.kind, "name": c.name, "about": c.about, "traits": sorted(c.traits),
             "params": [{"name": p.name, "default": p.default, "low": p.low, "high": p.high, "choices": list(p.choices)} for p in c.params]}
            for _, c in sorted(self.items.items())
        ]


CANONICIZERS, TOKENIZERS, DRIVERS, CULLERS, DISTANCES, METHODS = (
    Registry(k) for k in ("canonicizer", "tokenizer", "event_driver", "event_culler", "distance", "method")
)
REGISTRIES = {r.kind: r for r in (CANONICIZERS, TOKENIZERS, DRIVERS, CULLERS, DISTANCES, METHODS)}


@dataclass(frozen=True)
class Spec:
    """A component's name and parameters."""

    name: str
    params: dict[str, Any] = field(default_factory=dict)

    @staticmethod
    def of(x: Spec | dict | str) -> Spec:
        if isinstance(x, Spec):
            return x
        if isinstance(x, dict):
            return Spec(x["name"], dict(x.get("params") or {}))
        return Spec.parse(x)

    @staticmethod
    def parse(text: str) -> Spec:
        """``name`` or ``name:key=value,key=value``."""
        name, _, rest = text.partition(":")
        pairs = [p.partition("=") for p in rest.split(",") if p]
        if any(not eq for _, eq, _ in pairs):
            raise BadParameter(f"{text!r}: parameters are written key=value")
        return Spec(name.strip(), {k.strip(): v.strip() for k, _, v in pairs})


@dataclass(frozen=True)
class Config:
    """The logical plan: canonicizers, event drivers, cullers, a distance and a method."""

    event_drivers: tuple = ()
    canonicizers: tuple = ()
    event_cullers: tuple = ()
    distance: Any = None
    method: Any = "nearest_neighbor"

    def __post_init__(self):
        for name in ("event_drivers", "canonicizers", "event_cullers"):
            object.__setattr__(self, name, tuple(Spec.of(x) for x in getattr(self, name)))
        for name in ("distance", "method"):
            value = getattr(self, name)
            object.__setattr__(self, name, None if value is None else Spec.of(value))

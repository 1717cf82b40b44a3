"""Named tools: functions registered with a description, found again by name."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points

GROUP = "stonecrop.tools"


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    run: Callable
    parameters: dict


@dataclass
class Registry:
    tools: dict[str, Tool] = field(default_factory=dict)
    loaded: bool = False

    def register(self, f: Callable | None = None, *, name: str | None = None) -> Callable:
        """As a decorator, with or without a name."""
        def add(f: Callable) -> Callable:
            kinds = {k: str(p.annotation) for k, p in inspect.signature(f).parameters.items()}
            self.tools[name or f.__name__] = Tool(name or f.__name__, inspect.getdoc(f) or "", f, kinds)
            return f

        return add(f) if f is not None else add

    def load_entry_points(self) -> None:
        """Import what installed packages register, once."""
        if not self.loaded:
            self.loaded = True
            for e in entry_points(group=GROUP):
                e.load()

    def get(self, name: str) -> Tool:
        if name not in self.tools:
            raise KeyError(f"no tool {name!r}; there are {sorted(self.tools)}")
        return self.tools[name]


tools = Registry()

"""The order of models."""

from __future__ import annotations

from collections.abc import Iterable, Mapping


class CycleError(ValueError):
    """Models refer to each other in a circle."""


class MissingModelError(ValueError):
    """A model refers to one that doesn't exist."""


def layers(refs: Mapping[str, Iterable[str]]) -> list[list[str]]:
    """Models in layers, each after all it refers to; names sorted within a layer."""
    wanted = {name: set(r) for name, r in refs.items()}
    for name, needs in wanted.items():
        if missing := needs - wanted.keys():
            raise MissingModelError(f"{name} refers to {sorted(missing)}")
    out, done = [], set()
    while len(done) < len(wanted):
        ready = sorted(n for n, needs in wanted.items() if n not in done and needs <= done)
        if not ready:
            raise CycleError(f"circle among {sorted(wanted.keys() - done)}")
        out.append(ready)
        done.update(ready)
    return out


def select(planned: list[list[str]], name: str | None) -> list[list[str]]:
    """Only the named model, without its ancestors; an unknown name selects nothing."""
    if name is None:
        return planned
    return [[name] for layer in planned if name in layer]

"""Event hooks around actions: handlers get the event's parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

EVENTS = ("program_start", "program_done", "command_start", "command_done", "archive_start", "archive_done", "error", "warning")


class Hooks:
    def __init__(self) -> None:
        self.handlers: dict[str, list[Callable[[dict], None]]] = {e: [] for e in EVENTS}

    def on(self, event: str, handler: Callable[[dict], None]) -> None:
        if event not in self.handlers:
            raise ValueError(f"no event {event}")
        self.handlers[event].append(handler)

    def fire(self, event: str, **params) -> None:
        for handler in self.handlers[event]:
            handler(params)

    @contextmanager
    def command(self, name: str) -> Iterator[None]:
        self.fire("command_start", command=name)
        try:
            yield
        except Exception as e:
            self.fire("error", command=name, message=str(e))
            raise
        self.fire("command_done", command=name)


def run(hooks: Hooks, spark, names: list[str], sf_dir: str, act: Callable | None = None) -> dict[str, object]:
    """Run registered queries by name, with events around the program, each command and each archive (its tables' folder).

    act: what is done with a query's DataFrame, by default counting its rows. A query that fails fires
    ``error`` and ends the program; one without rows fires ``warning``.
    """
    from stratafold.plans.registry import QUERIES

    out: dict[str, object] = {}
    hooks.fire("program_start", commands=list(names))
    try:
        for name in names:
            with hooks.command(name):
                hooks.fire("archive_start", arcname=sf_dir, command=name)
                out[name] = (act or (lambda df: df.count()))(QUERIES[name](spark, sf_dir))
                if out[name] == 0:
                    hooks.fire("warning", command=name, message="no rows")
                hooks.fire("archive_done", arcname=sf_dir, command=name)
    finally:
        hooks.fire("program_done", commands=list(out))
    return out

"""Listeners that run on the driver, in order; one that raises stops the rest."""

from __future__ import annotations

from collections.abc import Callable


class Events:
    def __init__(self) -> None:
        self.listeners: dict[str, list[Callable]] = {}

    def on(self, event: str, callback: Callable) -> None:
        listeners = self.listeners.setdefault(event, [])
        if callback not in listeners:
            listeners.append(callback)

    def off(self, event: str, callback: Callable) -> None:
        if callback in self.listeners.get(event, []):
            self.listeners[event].remove(callback)

    def emit(self, event: str, *args) -> None:
        for callback in list(self.listeners.get(event, [])):
            callback(*args)

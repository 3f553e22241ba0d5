"""Subscriptions to resources within one process. Row 2.12 of the survey, A8."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Subscription:
    uri: str
    number: int
    notify: Callable[[str], None] = field(compare=False)


class Bus:
    """Subscribers by resource. A subscriber that fails is dropped; the others still hear."""

    def __init__(self) -> None:
        self._lock, self._next, self._by_uri = threading.Lock(), 0, {}

    def subscribe(self, uri: str, notify: Callable[[str], None]) -> Subscription:
        with self._lock:
            self._next += 1
            s = Subscription(uri, self._next, notify)
            self._by_uri.setdefault(uri, []).append(s)
            return s

    def unsubscribe(self, s: Subscription) -> bool:
        with self._lock:
            held = self._by_uri.get(s.uri, [])
            if s not in held:
                return False
            held.remove(s)
            return True

    def remove_first(self, uri: str) -> bool:
        with self._lock:
            held = self._by_uri.get(uri, [])
            return bool(held) and held.pop(0) is not None

    def publish(self, uri: str) -> int:
        """How many heard."""
        with self._lock:
            held = list(self._by_uri.get(uri, []))
        heard = 0
        for s in held:
            try:
                s.notify(uri)
                heard += 1
            except Exception:  # noqa: BLE001
                self.unsubscribe(s)
        return heard

    def count(self, uri: str | None = None) -> int:
        with self._lock:
            return sum(len(v) for k, v in self._by_uri.items() if uri in (None, k))

"""Driver-side caches of small results."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Hashable
from threading import Lock
from typing import Generic, TypeVar

V = TypeVar("V")


class LRU(Generic[V]):
    """The most recently used entries, up to a number."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self._held, self._lock = capacity, OrderedDict(), Lock()
        self.hits = self.misses = 0

    def get(self, key: Hashable) -> V | None:
        with self._lock:
            if key not in self._held:
                self.misses += 1
                return None
            self.hits += 1
            self._held.move_to_end(key)
            return self._held[key]

    def put(self, key: Hashable, value: V) -> None:
        with self._lock:
            self._held[key] = value
            self._held.move_to_end(key)
            while len(self._held) > self.capacity:
                self._held.popitem(last=False)

    def clear(self) -> None:
        with self._lock:
            self._held.clear()

    def __len__(self) -> int:
        return len(self._held)

    def __contains__(self, key: Hashable) -> bool:
        return key in self._held

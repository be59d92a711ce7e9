"""Memory that stays where it is: a cache pickles as an empty one, so tasks start with none of the driver's."""

from __future__ import annotations

from collections.abc import Callable


class Cache(dict):
    """Results of one function by its arguments, the oldest dropped beyond most."""

    def __init__(self, most: int = 512):
        super().__init__()
        self.most = most

    def __reduce__(self):
        return Cache, (self.most,)

    def get_or(self, key, make: Callable):
        if key not in self:
            if len(self) >= self.most:
                del self[next(iter(self))]
            self[key] = make()
        return self[key]

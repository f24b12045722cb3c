"""A bounded memory of computed values for Python workers."""

from __future__ import annotations

from collections.abc import Callable

#: Longer keys are computed each time: they hardly repeat, and without them entries have a bounded size.
LONGEST_KEY = 64


class Recent(dict):
    """``recent[key]`` computes what it doesn't hold. Two generations of ``limit`` entries bound it: what is used again
    within a generation stays, so frequent keys are computed once."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONGEST_KEY:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

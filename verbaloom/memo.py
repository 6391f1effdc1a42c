"""A bounded memory of results by key."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import filterfalse


class Remembered:
    """Results by key in two generations: a key met again moves from the older to the newer one,
    and a newer one that is full becomes the older. What recurs stays and what doesn't leaves, at any
    size of input; at most two generations (and one batch's keys) are held."""

    def __init__(self, generation: int):
        self.generation, self.new, self.old = generation, {}, {}

    def missing(self, keys: Iterable[str]) -> set[str]:
        """Distinct keys without a result; results of all others are in `new` afterwards."""
        fresh = set(filterfalse(self.new.__contains__, keys))
        if self.new and len(self.new) + len(fresh) > self.generation:
            self.old, self.new = self.new, {}
            fresh = set(keys)
        old = self.old
        known = [k for k in fresh if k in old]
        self.new.update((k, old[k]) for k in known)
        return fresh.difference(known)
